"""The spectral operators as SQL, for the oracles: resampling, Welch, band powers."""

from catalog.base import cte


def spectrum_cte(name: str, beats: str, segment: int) -> None:
    """Band powers per group from a relation ``(g, i, rr)`` with ``i`` from 1.

    Linear resampling at 4 Hz, half-overlapping periodic-Hann segments without their
    mean, one-sided density averaged over segments, trapezoids per band.
    """
    cte(f"{name}_t", beats, f"""
        SELECT g, i, rr, t - first_value(t) OVER (PARTITION BY g ORDER BY i) AS t, m FROM (
          SELECT g, i, rr, sum(rr) OVER (PARTITION BY g ORDER BY i) / 1000.0 AS t, count(*) OVER (PARTITION BY g) AS m FROM {beats})""")
    cte(f"{name}_u", f"{name}_t", f"""
        SELECT u.g, u.j, a.rr + (b.rr - a.rr) * (u.x - a.t) / (b.t - a.t) AS x, u.len, least({segment}, u.len) AS seg FROM (
          SELECT g, r.j, r.j * 0.25E0 AS x, CAST(ceil(dur * 4) AS BIGINT) AS len FROM (SELECT g, max(t) AS dur FROM {name}_t GROUP BY g),
            LATERAL (SELECT unnest(range(CAST(ceil(dur * 4) AS BIGINT))) AS j) r) u
        ASOF JOIN {name}_t a ON a.g = u.g AND u.x >= a.t
        JOIN {name}_t b ON b.g = a.g AND b.i = a.i + 1""")
    cte(f"{name}_s", f"{name}_u", f"""
        SELECT g, s, k, seg, (x - avg(x) OVER (PARTITION BY g, s)) * h AS y, sum(h * h) OVER (PARTITION BY g, s) AS hh FROM (
          SELECT u.g, q.s, u.j - q.s * (u.seg - u.seg // 2) AS k, u.seg, u.x,
                 0.5 - 0.5 * cos(2 * pi() * (u.j - q.s * (u.seg - u.seg // 2)) / u.seg) AS h
          FROM {name}_u u, LATERAL (SELECT unnest(range(CAST((u.len - u.seg) // (u.seg - u.seg // 2) AS BIGINT) + 1)) AS s) q
          WHERE u.j >= q.s * (u.seg - u.seg // 2) AND u.j < q.s * (u.seg - u.seg // 2) + u.seg)""")
    cte(f"{name}_p", f"{name}_s", f"""
        SELECT g, f * 4.0E0 / seg AS freq, avg(p) AS p FROM (
          SELECT s.g, s.s, s.seg, f.f, (pow(sum(y * cos(2 * pi() * f.f * k / seg)), 2) + pow(sum(y * sin(2 * pi() * f.f * k / seg)), 2))
                 / (4.0 * max(hh)) * CASE WHEN f.f = 0 OR f.f * 2 = seg THEN 1 ELSE 2 END AS p
          FROM {name}_s s, LATERAL (SELECT unnest(range(CAST(floor(0.51 * seg / 4) AS BIGINT) + 1)) AS f) f
          GROUP BY s.g, s.s, s.seg, f.f) GROUP BY g, f, seg""")
    cte(f"{name}_b", f"{name}_p", f"""
        SELECT g, sum(CASE WHEN freq < 0.04 AND nf < 0.04 AND freq >= 0.003 THEN a ELSE 0 END) AS vlf,
               sum(CASE WHEN freq >= 0.04 AND nf <= 0.15 THEN a ELSE 0 END) AS lf,
               sum(CASE WHEN freq >= 0.15 AND nf <= 0.4 THEN a ELSE 0 END) AS hf FROM (
          SELECT g, freq, lead(freq) OVER w AS nf, (p + lead(p) OVER w) / 2 * (lead(freq) OVER w - freq) AS a
          FROM {name}_p WINDOW w AS (PARTITION BY g ORDER BY freq)) GROUP BY g""")


# Windows of 60 samples give spectra that pass the guards (30 beats, 30 seconds).
cte("long_beats", "night", """
    SELECT user_id || '/' || night || '/' || (pos // 60) AS g, rr,
           row_number() OVER (PARTITION BY user_id, night, pos // 60 ORDER BY ts) AS i
    FROM night WHERE (pos // 60) * 60 < n - 60 AND rr > 200 AND rr < 2500""")
spectrum_cte("sp", "long_beats", 128)
cte("night_beats", "night", """
    SELECT user_id || '/' || night AS g, rr, row_number() OVER (PARTITION BY user_id, night ORDER BY ts) AS i
    FROM night WHERE rr > 200 AND rr < 2500""")
spectrum_cte("spn", "night_beats", 256)
