"""Official JSON documents as tables (IO2-IO12, IO18, IO19).

Input frames have key columns and a text column ``doc``. Documents are parsed with
explicit schemas, of which Spark reads only the selected fields, and flattened with
array functions inside the row; nothing is shuffled unless rows are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.functions.scalars import clock_minute, digits_number, night_minute, official_stage, to_number
from nocturne.operators.nights import UTC_OFFSET_S
from nocturne.schema import sport_table
from nocturne.sources.packets import decode_records, split_records

# Document layouts.
CARD = """struct<title string, duration_display string, arrow_stat array<struct<current_stat_text string>>,
    legend_entries array<struct<style string, stat_display string>>,
    heart_rate_zones array<struct<id string, bar_graph_tile_percentage_display string, bar_graph_tile_time_display string,
        bar_graph struct<time_bound_ranges array<struct<lower_endpoint double, upper_endpoint double>>>>>,
    plots array<struct<plot struct<style string, segments array<struct<points array<struct<position_x double,
        data_scrubber_details struct<value_display string>>>>>>>>>"""
CONTENT = f"""struct<id string, score_display string, score_display_suffix string, gauge_fill_percentage double,
    metrics array<struct<id string, title string, status string>>, arrow_stat array<struct<current_stat_text string>>,
    card_content array<struct<content {CARD}>>>"""
SECTIONS = f"sections array<struct<id string, items array<struct<type string, content {CONTENT}>>>>"
DAY_SCHEMA = f"""recovery struct<{SECTIONS}>, sleep struct<{SECTIONS}>, strain struct<{SECTIONS}>,
    last_night struct<header_section struct<destination struct<parameters struct<start_time string, end_time string>>>, {SECTIONS}>"""
CYCLES_SCHEMA = """array<struct<id long, start string, end string, score_state string, score struct<strain double,
    kilojoule double, average_heart_rate double, max_heart_rate double, sleep_performance double>>>"""
POINTS = "array<struct<timestamp string, time string, value double, stress_level double>>"
STRESS_SCHEMA = f"""stressGraph struct<data_points {POINTS}, dataPoints {POINTS}>,
    sections array<struct<items array<struct<content struct<data_points {POINTS}, timeline {POINTS}>>>>>,
    data_points {POINTS}, timeline {POINTS}"""
ACTIVITY_SCHEMA = """title_bar struct<title_display string, subtitle_display string>,
    horizontal_stats array<struct<stat_title_display string, stat_main_value_display string>>"""
HEALTH_SCHEMA = """sections array<struct<items array<struct<content struct<items array<struct<type string,
    content struct<age_value_display string, age_subtitle_display string,
        style_values struct<age double, pace_of_aging double, years_difference double>>>>>>>>>"""
HAR_SCHEMA = """log struct<entries array<struct<request struct<url string, _content struct<text string>,
    postData struct<text string>>>>>"""
WORKOUT_SCHEMA = """id string, activity_id string, name string, sport_name string, sport_id int, strain double,
    start string, end string, duration_ms double, duration_s double, average_heart_rate int, max_heart_rate int,
    kilojoules double, score struct<strain double, average_heart_rate int, max_heart_rate int, kilojoule double,
        distance_meter double, zone_duration map<string, double>>"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its text and, where the path has one, its date."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    date = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1)
    return files.select("path", F.when(date != "", F.to_date(date)).alias("date"), F.col("value").alias("doc"))


def epoch(text: Column) -> Column:
    """Seconds of an ISO time with zone."""
    return F.unix_micros(F.try_to_timestamp(text)) / 1_000_000


def _items(sections: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(sections, F.array()), lambda s: s["items"]))


def _last(values: Column) -> Column:
    """Last non-NULL entry, as a later tile replaces an earlier one."""
    found = F.filter(values, lambda v: v.isNotNull())
    return F.get(found, F.size(found) - 1)


def _gauge(part: Column, gauge_id: str) -> Column:
    hits = F.transform(
        _items(part["sections"]),
        lambda i: F.when(
            (i["type"] == "SCORE_GAUGE") & (i["content"]["id"] == gauge_id),
            i["content"]["score_display"].try_cast("double"),
        ),
    )
    return _last(hits)


def _tile(part: Column, contains: str, not_before: tuple[str, ...] = ()) -> Column:
    """Status of the contributor whose id has a word and none of the earlier words."""
    tiles = F.filter(_items(part["sections"]), lambda i: i["type"] == "CONTRIBUTORS_TILE")
    metrics = F.flatten(F.transform(tiles, lambda i: F.coalesce(i["content"]["metrics"], F.array())))

    def pick(m: Column) -> Column:
        hit = F.contains(m["id"], F.lit(contains))
        for other in not_before:
            hit = hit & ~F.contains(m["id"], F.lit(other))
        return F.when(hit, F.regexp_replace(m["status"], "[%,]", "").try_cast("double"))

    return _last(F.transform(metrics, pick))


def _day(df: DataFrame) -> DataFrame:
    # exploding one entry keeps the parsed document a column: used directly, every
    # field read from it would parse the text again
    parsed = F.explode(F.array(F.from_json("doc", DAY_SCHEMA)))
    return df.withColumn("_d", parsed).drop("doc")


def day_scores(df: DataFrame) -> DataFrame:
    """Scores and contributors of a day document as columns."""
    keys = [c for c in df.columns if c != "doc"]
    rec, slp, strn = F.col("_d.recovery"), F.col("_d.sleep"), F.col("_d.strain")
    order = ("STRESS", "EFFICIENCY", "CONSISTENCY")
    return _day(df).select(
        *keys,
        _gauge(rec, "RECOVERY_SCORE_GAUGE").alias("recovery_score"),
        _tile(rec, "HRV").alias("hrv_ms"),
        _tile(rec, "RHR", ("HRV",)).alias("rhr_bpm"),
        _tile(rec, "RESPIRATORY", ("HRV", "RHR")).alias("resp_rate"),
        _tile(rec, "SLEEP_PERFORMANCE", ("HRV", "RHR", "RESPIRATORY")).alias("sleep_performance"),
        _gauge(slp, "SLEEP_SCORE_GAUGE").alias("sleep_score"),
        _tile(slp, "STRESS").alias("stress_pct"),
        _tile(slp, "EFFICIENCY", order[:1]).alias("sleep_efficiency"),
        _tile(slp, "CONSISTENCY", order[:2]).alias("sleep_consistency"),
        _tile(slp, "HOURS", order).alias("hours_vs_needed"),
        _gauge(strn, "STRAIN_SCORE_GAUGE").alias("strain_score"),
        _tile(strn, "STEPS").cast("long").alias("steps"),
    )


def contributor_titles(df: DataFrame, part: str = "recovery") -> DataFrame:
    """Display score, gauge fill and the contributors by title, as the app reads them."""
    keys = [c for c in df.columns if c != "doc"]
    items = _items(F.col(f"_d.{part}.sections"))
    gauge = _last(F.transform(items, lambda i: F.when(i["type"] == "SCORE_GAUGE", i["content"])))
    tiles = F.flatten(F.transform(
        F.filter(items, lambda i: i["type"] == "CONTRIBUTORS_TILE"), lambda i: i["content"]["metrics"]
    ))
    by_title = F.map_from_entries(F.transform(tiles, lambda m: F.struct(F.upper(m["title"]), m["status"])))
    score = F.coalesce(digits_number(gauge["score_display"]), gauge["gauge_fill_percentage"] * 100)
    return _day(df).select(*keys, score.alias("score"), gauge["gauge_fill_percentage"].alias("fill"), by_title.alias("contributors"))


def cycles(df: DataFrame, day: str = "end", offset_s: int = UTC_OFFSET_S) -> DataFrame:
    """Scored cycles; the day is that of the local end, or of the start text."""
    keys = [c for c in df.columns if c != "doc"]
    rows = df.select(*keys, F.explode(F.from_json("doc", CYCLES_SCHEMA)).alias("c")).where(
        "c.score_state = 'SCORED' and c.score is not null"
    )
    if day == "end":
        rows = rows.where("c.end is not null")
        date = F.to_date(F.timestamp_seconds(epoch(F.col("c.end")) + offset_s))
    else:
        date = F.to_date(F.substring("c.start", 1, 10))
    return rows.select(
        *keys, F.col("c.id").alias("cycle_id"), date.alias("date"), F.col("c.score.strain").alias("strain"),
        F.col("c.score.kilojoule").alias("kilojoule"), F.col("c.score.average_heart_rate").alias("avg_hr"),
        F.col("c.score.max_heart_rate").alias("max_hr"),
    )


def _night_bounds(d: Column) -> tuple[Column, Column]:
    p = d["last_night"]["header_section"]["destination"]["parameters"]
    return epoch(p["start_time"]), epoch(p["end_time"])


def stage_timeline(df: DataFrame) -> DataFrame:
    """Stage intervals in whole inclusive seconds from fractional ranges of the night."""
    keys = [c for c in df.columns if c != "doc"]
    d = F.col("_d")
    zones = F.get(F.get(F.get(d["last_night"]["sections"], 0)["items"], 0)["content"]["card_content"], 2)
    start, end = _night_bounds(d)
    rows = _day(df).withColumns({"_s": start, "_e": end, "_z": zones["content"]["heart_rate_zones"]}).where("_e > _s")
    spans = rows.select(*keys, "_s", "_e", F.explode("_z").alias("z")).select(
        *keys, "_s", "_e", official_stage(F.col("z.id")).alias("stage"),
        F.explode("z.bar_graph.time_bound_ranges").alias("r"),
    ).where("stage is not null")
    at = lambda share: F.floor(F.col("_s") + F.col(share) * (F.col("_e") - F.col("_s")))
    return spans.select(*keys, "stage", at("r.lower_endpoint").alias("start_ts"), at("r.upper_endpoint").alias("end_ts"))


def expand_minutes(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """One row per minute of each interval; the interval that ends last wins a minute.

    Only the intervals are shuffled: those of a key meet in one row (bounded by the day), the last end first, and
    each keeps the minutes that no interval before it covers. All before it end no earlier, so what they leave ends where
    the first of them starts; only an interval given backwards is looked up minute by minute.
    """
    lo, hi = F.floor(F.col("start_ts") / 60), F.floor(F.col("end_ts") / 60)
    spans = intervals.select(
        *keys, F.struct("end_ts", (-F.col("start_ts")).alias("first"), lo.alias("from"), hi.alias("to"), "stage").alias("_i")
    ).where("_i.from is not null and _i.to is not null")
    ranked = spans.groupBy(*keys).agg(F.sort_array(F.collect_list("_i"), False).alias("_all"))
    each = ranked.select("*", F.posexplode("_all").alias("_at", "_i"))
    before = F.slice("_all", 1, F.col("_at"))
    starts = F.array_min(F.transform(before, lambda x: F.least(x["from"], x["to"])))
    end = F.least(F.col("_i.to"), F.coalesce(starts - 1, F.col("_i.to")))
    left = F.when(F.col("_i.from") <= end, F.sequence(F.col("_i.from"), F.greatest(end, F.col("_i.from"))))
    covers = lambda x, m: m.between(F.least(x["from"], x["to"]), F.greatest(x["from"], x["to"]))
    back = F.filter(F.sequence(F.col("_i.to"), F.col("_i.from")), lambda m: ~F.exists(before, lambda x: covers(x, m)))
    return each.select(
        *keys, F.explode(F.when(F.col("_i.from") <= F.col("_i.to"), left).otherwise(back)).alias("minute"), F.col("_i.stage").alias("stage")
    )


def scrubber_labels(df: DataFrame) -> DataFrame:
    """Stage per clock minute from the raw text, first per minute, in night order."""
    keys = [c for c in df.columns if c != "doc"]
    pair = (
        r'"secondary_contextual_display"\s*:\s*"([^"]+)"\s*,\s*"scrubber_style"\s*:\s*'
        r'"(AWAKE|LIGHT_SLEEP|SWS_SLEEP|REM_SLEEP)"'
    )
    found = df.select(
        *keys, F.posexplode(F.arrays_zip(
            F.regexp_extract_all("doc", F.lit(pair), F.lit(1)).alias("clock"),
            F.regexp_extract_all("doc", F.lit(pair), F.lit(2)).alias("style"),
        )).alias("at", "p"),
    )
    labels = found.select(
        *keys, "at", clock_minute(F.col("p.clock")).alias("clock"), official_stage(F.col("p.style")).alias("stage")
    ).where("clock is not null")
    first = labels.groupBy(*keys, "clock").agg(F.min_by("stage", "at").alias("stage"))
    return first.withColumn("night_order", night_minute(F.col("clock")))


def stress_timeline(df: DataFrame) -> DataFrame:
    """Stress per minute of the night from the first plot of the stress card."""
    keys = [c for c in df.columns if c != "doc"]
    d = F.col("_d")
    start, end = _night_bounds(d)
    cards = F.flatten(F.transform(
        F.filter(_items(d["last_night"]["sections"]), lambda i: i["content"]["id"] == "sleep_stress"),
        lambda i: i["content"]["card_content"],
    ))
    first_points = F.transform(cards, lambda c: F.get(F.get(c["content"]["plots"], 0)["plot"]["segments"], 0)["points"])
    points = F.get(F.filter(first_points, lambda p: F.size(F.coalesce(p, F.array())) > 0), 0)
    rows = _day(df).withColumns({"_s": start, "_e": end, "_p": points}).where("_e > _s").select(
        *keys, "_s", "_e", F.posexplode("_p").alias("at", "p")
    )
    minute = F.floor(F.floor(F.col("_s") + F.coalesce("p.position_x", F.lit(0.0)) * (F.col("_e") - F.col("_s"))) / 60)
    value = F.coalesce(F.col("p.data_scrubber_details.value_display"), F.lit("0")).try_cast("double")
    return rows.select(*keys, "at", minute.alias("minute"), value.alias("stress")).where("stress is not null").groupBy(
        *keys, "minute"
    ).agg(F.max_by("stress", "at").alias("stress"))


def stress_points(df: DataFrame) -> DataFrame:
    """Stress points from the first of three places that has any."""
    keys = [c for c in df.columns if c != "doc"]
    j = F.from_json("doc", STRESS_SCHEMA)
    none = F.array().cast(POINTS)
    graph = F.coalesce(F.col("_j.stressGraph.data_points"), F.col("_j.stressGraph.dataPoints"), none)
    nested = F.flatten(F.transform(
        F.flatten(F.transform(F.coalesce(F.col("_j.sections"), F.array()), lambda s: s["items"])),
        lambda i: F.coalesce(i["content"]["data_points"], i["content"]["timeline"], none),
    ))
    top = F.coalesce(F.col("_j.data_points"), F.col("_j.timeline"), none)

    def usable(points: Column) -> Column:
        return F.filter(
            points,
            lambda p: F.coalesce(p["timestamp"], p["time"]).isNotNull() & F.coalesce(p["value"], p["stress_level"]).isNotNull(),
        )

    g, n, t = usable(graph), usable(nested), usable(top)
    chosen = F.when(F.size(g) > 0, g).when(F.size(n) > 0, n).otherwise(t)
    rows = df.withColumn("_j", j).select(*keys, F.explode(chosen).alias("p"))
    return rows.select(
        *keys, epoch(F.coalesce("p.timestamp", "p.time")).cast("long").alias("timestamp"),
        F.coalesce("p.value", "p.stress_level").alias("stress"),
    ).where("timestamp is not null")


def activity_documents(df: DataFrame) -> DataFrame:
    """Title, subtitle, strain tile and the first date in the text."""
    keys = [c for c in df.columns if c != "doc"]
    tiles = F.filter("_j.horizontal_stats", lambda h: F.contains(F.upper(h["stat_title_display"]), F.lit("STRAIN")))
    strain = F.get(tiles, F.size(tiles) - 1)["stat_main_value_display"]
    date = F.regexp_extract("doc", r"(20\d\d-\d\d-\d\d)", 1)
    return df.withColumn("_j", F.from_json("doc", ACTIVITY_SCHEMA)).select(
        *keys, F.coalesce("_j.title_bar.title_display", F.lit("Activity")).alias("title"),
        F.coalesce("_j.title_bar.subtitle_display", F.lit("")).alias("subtitle"),
        strain.alias("strain"), F.when(date != "", date).alias("activity_date"),
    )


def activities_by_date(df: DataFrame) -> DataFrame:
    """Activities of a user's day as one list (bounded by the day)."""
    return activity_documents(df).where("activity_date is not null").groupBy("user_id", "activity_date").agg(
        F.sort_array(F.collect_list(F.struct("title", "subtitle", "strain"))).alias("activities")
    )


def health_age(df: DataFrame, tile: str | None = None) -> DataFrame:
    """Age value and pace from the health tab; ``tile`` names the tile type if given."""
    keys = [c for c in df.columns if c != "doc"]
    subs = F.flatten(F.transform(
        F.flatten(F.transform("_j.sections", lambda s: s["items"])), lambda i: F.coalesce(i["content"]["items"], F.array())
    ))
    wanted = (lambda s: s["type"] == tile) if tile else (lambda s: s["content"]["age_value_display"].isNotNull())
    hits = F.filter(subs, wanted)
    c = F.get(hits, F.size(hits) - 1)["content"]
    return df.withColumn("_j", F.from_json("doc", HEALTH_SCHEMA)).withColumn("_c", c).select(
        *keys, "_c.age_value_display", "_c.age_subtitle_display", F.col("_c.style_values.age").alias("age"),
        F.col("_c.style_values.pace_of_aging").alias("pace"), F.col("_c.style_values.years_difference").alias("years_difference"),
    )


def stage_tiles(df: DataFrame) -> DataFrame:
    """Stage shares and hours from the first card with at least four stage tiles."""
    keys = [c for c in df.columns if c != "doc"]
    cards = F.flatten(F.transform(
        _items(F.col("_d.last_night.sections")), lambda i: F.coalesce(i["content"]["card_content"], F.array())
    ))
    zones = F.get(
        F.filter(
            F.transform(cards, lambda c: c["content"]["heart_rate_zones"]),
            lambda z: (F.size(F.coalesce(z, F.array())) >= 4) & F.exists(z, lambda x: x["id"] == "SWS_SLEEP"),
        ), 0,
    )
    tile = lambda stage, field: _last(F.transform("_z", lambda z: F.when(z["id"] == stage, z[field])))
    out = []
    for official, stage in (("AWAKE", "awake"), ("LIGHT_SLEEP", "light"), ("SWS_SLEEP", "deep"), ("REM_SLEEP", "rem")):
        out.append(to_number(tile(official, "bar_graph_tile_percentage_display")).alias(f"{stage}_pct"))
        out.append(to_number(tile(official, "bar_graph_tile_time_display")).alias(f"{stage}_hours"))
    return _day(df).withColumn("_z", zones).where("_z is not null").select(*keys, *out)


def find_ids(df: DataFrame, name: str = "activity_id") -> DataFrame:
    """Distinct values of a key anywhere in the text."""
    keys = [c for c in df.columns if c != "doc"]
    pattern = f'"{name}"\\s*:\\s*"?([^",}}\\]\\s]+)'
    return df.select(
        *keys, F.explode(F.array_distinct(F.regexp_extract_all("doc", F.lit(pattern), F.lit(1)))).alias(name)
    )


def find_efficiency(df: DataFrame) -> DataFrame:
    """First number between 0 and 100 under a key that mentions efficiency."""
    keys = [c for c in df.columns if c != "doc"]
    pattern = r'(?i)"[^"]*efficien[^"]*"\s*:\s*([0-9.]+)'
    values = F.transform(F.regexp_extract_all("doc", F.lit(pattern), F.lit(1)), lambda v: v.try_cast("double"))
    good = F.filter(values, lambda v: (v > 0) & (v <= 100))
    return df.select(*keys, F.get(good, 0).alias("efficiency"))


OFFICIAL_FIELDS = [
    "hours_of_sleep", "restorative_sleep", "time_in_bed", "pct_of_need", "healthy_min", "recent_strain_need",
    "consistency", "efficiency", "wake_events", "sleep_stress_pct", "hrv", "rhr", "respiratory_rate",
]


def official_fields(df: DataFrame) -> DataFrame:
    """The official fields of a night as texts, by section id and card title."""
    keys = [c for c in df.columns if c != "doc"]
    sections = F.col("_d.last_night.sections")

    def content(section: str) -> Column:
        return F.get(F.get(F.filter(sections, lambda s: s["id"] == section), 0)["items"], 0)["content"]

    stat = lambda c: F.get(c["arrow_stat"], 0)["current_stat_text"]
    cards = lambda c: F.coalesce(c["card_content"], F.array())
    titled = lambda c, t: stat(F.get(F.filter(cards(c), lambda b: b["content"]["title"] == t), 0)["content"])
    hours, needed, eff = content("hours_of_sleep"), content("hours_vs_needed"), content("sleep_efficiency")
    legend = F.get(needed["card_content"], 0)["content"]["legend_entries"]
    entry = lambda style: F.get(F.filter(legend, lambda e: e["style"] == style), 0)["stat_display"]
    metrics = F.flatten(F.transform(
        _items(F.col("_d.recovery.sections")), lambda i: F.coalesce(i["content"]["metrics"], F.array())
    ))
    tile = lambda word: _last(F.transform(
        metrics, lambda m: F.when(F.contains(m["id"], F.lit(word)), m["status"])
    ))
    values = [
        stat(hours), titled(hours, "RESTORATIVE SLEEP"),
        _last(F.transform(cards(hours), lambda b: b["content"]["duration_display"])),
        stat(needed), entry("HEALTHY_MIN"), entry("RECENT_STRAIN"), stat(content("sleep_consistency")), stat(eff),
        titled(eff, "WAKE EVENTS"), stat(content("sleep_stress")), tile("HRV"), tile("RHR"), tile("RESPIRATORY"),
    ]
    return _day(df).select(*keys, *[v.alias(n) for n, v in zip(OFFICIAL_FIELDS, values)])


def field_coverage(fields: DataFrame) -> DataFrame:
    """Documents per field that carry it."""
    long = fields.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(n).isNotNull().cast("int").alias("has")) for n in OFFICIAL_FIELDS
    ])).alias("f"))
    return long.groupBy("f.field").agg(F.sum("f.has").alias("n"))


def stage_segments(df: DataFrame) -> DataFrame:
    """Stage intervals of the night chart: smallest and largest x per segment."""
    keys = [c for c in df.columns if c != "doc"]
    cards = F.flatten(F.transform(
        _items(F.col("_d.last_night.sections")), lambda i: F.coalesce(i["content"]["card_content"], F.array())
    ))
    # the first plot is the heart-rate line
    plots = F.flatten(F.transform(cards, lambda c: F.slice(F.coalesce(c["content"]["plots"], F.array()), 2, 100)))
    style = F.col("p.plot.style")
    stage = (
        F.when(F.contains(style, F.lit("REM")), "rem").when(F.contains(style, F.lit("LIGHT")), "light")
        .when(F.contains(style, F.lit("SWS")), "deep").when(F.contains(style, F.lit("AWAKE")), "awake")
    )
    rows = _day(df).select(*keys, F.explode(plots).alias("p")).select(*keys, stage.alias("stage"), F.explode("p.plot.segments").alias("s"))
    xs = F.transform("s.points", lambda q: F.coalesce(q["position_x"], F.lit(0.0)))
    return rows.where("stage is not null and size(s.points) > 0").select(
        *keys, "stage", F.array_min(xs).alias("start_x"), F.array_max(xs).alias("end_x")
    )


def stage_metrics(df: DataFrame, part: str = "sleep") -> DataFrame:
    """Stage and disturbance texts from contributor titles."""
    keys = [c for c in df.columns if c != "doc"]
    metrics = F.flatten(F.transform(
        _items(F.col(f"_d.{part}.sections")), lambda i: F.coalesce(i["content"]["metrics"], F.array())
    ))

    def pick(*words: str) -> Column:
        def hit(m: Column) -> Column:
            found = F.lit(False)
            for w in words:
                found = found | F.contains(F.upper(m["title"]), F.lit(w))
            return F.when(found, m["status"])

        return _last(F.transform(metrics, hit))

    return _day(df).select(
        *keys, pick("REM").alias("rem"), pick("DEEP", "SWS").alias("deep"), pick("LIGHT").alias("light"),
        pick("AWAKE").alias("awake"), pick("DISTURBANCES").alias("disturbances"), pick("TIME IN BED").alias("time_in_bed"),
    )


def workouts(df: DataFrame) -> DataFrame:
    """Workout records with sport names; duration from milliseconds, seconds or the bounds."""
    keys = [c for c in df.columns if c != "doc"]
    w = df.withColumn("w", F.from_json("doc", WORKOUT_SCHEMA))
    start, end = epoch(F.col("w.start")).cast("long"), epoch(F.col("w.end")).cast("long")
    duration = F.coalesce(F.col("w.duration_ms") / 1000, F.col("w.duration_s"), (end - start).cast("double"))
    rows = w.select(
        *keys, F.coalesce("w.id", "w.activity_id", F.lit("")).alias("workout_id"), F.col("w.sport_id").alias("sport_id"),
        F.coalesce("w.name", "w.sport_name").alias("name"), F.coalesce("w.strain", "w.score.strain").alias("strain"),
        F.coalesce("w.average_heart_rate", "w.score.average_heart_rate").alias("avg_hr"),
        F.coalesce("w.max_heart_rate", "w.score.max_heart_rate").alias("max_hr"),
        F.round(F.coalesce("w.kilojoules", "w.score.kilojoule") / 4.184).alias("kcal"), start.alias("start_ts"),
        duration.alias("duration_s"), (F.col("w.score.distance_meter") / 1000).alias("distance_km"),
        F.col("w.score.zone_duration").alias("zone_duration"),
    )
    # the sport catalogue has a fixed size
    sports = F.broadcast(sport_table(df.sparkSession))
    return rows.join(sports, "sport_id", "left").withColumn(
        "name", F.coalesce("name", "sport_name", F.lit("Activity"))
    ).drop("sport_name")


def har_records(df: DataFrame, url_part: str = "metrics-service") -> DataFrame:
    """Decoded 124-byte records of captured uploads; the last one per key and second wins.

    ``seq`` orders captures; the pick is combined before the shuffle. Only the second and the checks of a record are
    read for it, the fields of the picked records after it.
    """
    keys = [c for c in df.columns if c not in ("doc", "seq")]
    entries = df.select(*keys, "seq", F.posexplode(F.from_json("doc", HAR_SCHEMA)["log"]["entries"]).alias("entry", "e"))
    text = F.coalesce("e.request._content.text", "e.request.postData.text")
    bodies = entries.where(F.contains("e.request.url", F.lit(url_part))).select(
        *keys, "seq", "entry", F.unbase64(text).alias("body")
    ).where("body is not null")
    valid = decode_records(split_records(bodies)).where("d_ok").select(*keys, "seq", "entry", "at", F.col("d.timestamp").alias("timestamp"), F.unhex("record").alias("record"))
    picked = valid.groupBy(*keys, "timestamp").agg(F.max_by("record", F.struct("seq", "entry", "at")).alias("record"))
    decoded = decode_records(picked.withColumn("record", F.hex("record")))
    fields = [f for f in ("hr", "rr_count", "rr1_ms", "rr2_ms", "rr3_ms", "acc_x", "acc_y", "acc_z", "movement", "gyro", "spo2")]
    return decoded.select(*keys, "timestamp", *[F.col(f"d.{f}").alias(f) for f in fields])
