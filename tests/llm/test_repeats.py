import hashlib
import zlib

import numpy as np
import pytest

from nocturne.llm import pieces, substring, suffix


def key(r):
    return (2**63 - 1 if r.doc_id is None else r.doc_id, zlib.crc32((r.text or "").encode()))


def marks(rows, tokens_of, window):
    """Tokens of each row covered by a window that also starts earlier; equal rows are one document."""
    seen, out = set(), {}
    for k, tokens in sorted({key(r): tokens_of(r.text) for r in rows}.items()):
        gone = bytearray(len(tokens))
        for i in range(len(tokens) - window + 1):
            w = tuple(tokens[i : i + window])
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        out[k] = (tokens, gone)
    return out


@pytest.mark.parametrize("window,gram", [(20, 6), (5, 2), (3, 3)])
def test_words_agree_with_brute_force(hard, window, gram):
    rows = hard.select("doc_id", "text").collect()
    expected = marks(rows, lambda t: (t or "").encode().split(), window)
    want = []
    for r in rows:
        words, gone = expected[key(r)]
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want.append((str(r.doc_id), len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digests(hard, window=window, gram=gram).collect()]
    assert sorted(got) == sorted(want)


def test_cut_texts_keep_their_layout(hard):
    rows = hard.select("doc_id", "text").collect()
    expected = marks(rows, lambda t: (t or "").encode().split(), 20)
    got = substring.drop_repeats(hard)
    assert got.columns == hard.columns
    for r in got.select("doc_id", "text", "source").collect():
        if r.doc_id not in (2, 3, None):
            old = next(x for x in rows if x.doc_id == r.doc_id)
            words, gone = expected[key(old)]
            assert (r.text is None) == (old.text is None)
            assert (r.text or "").encode().split() == [w for w, g in zip(words, gone) if not g]
            assert any(gone) or r.text == old.text


@pytest.mark.parametrize("window,gram,bucket", [(100, 32, 20_000), (100, 32, 1), (12, 8, 50)])
def test_bytes_agree_with_brute_force(hard, window, gram, bucket):
    rows = hard.select("doc_id", "text").collect()
    expected = marks(rows, lambda t: (t or "").encode(), window)
    want = []
    for r in rows:
        data, gone = expected[key(r)]
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want.append((str(r.doc_id), len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix.remove_repeated_strings(hard, window=window, gram=gram, bucket=bucket).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty_tables(none):
    assert substring.removal_digests(none).count() == 0
    assert substring.drop_repeats(none).count() == 0
    assert suffix.remove_repeated_strings(none).count() == 0


def test_multikey_groups():
    r = np.random.default_rng(0)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    at = np.arange(3980)
    for length in (8, 11, 16, 20):
        alive, group = suffix.multikey_groups(data, at, length)
        sets = {}
        for i in at:
            sets.setdefault(data[i : i + length].tobytes(), set()).add(int(i))
        found = {}
        for i, g in zip(alive.tolist(), group.tolist()):
            found.setdefault(g, set()).add(i)
        assert sorted(map(sorted, found.values())) == sorted(sorted(s) for s in sets.values() if len(s) > 1)


def test_pieces_hold_each_window_once():
    r = np.random.default_rng(1)
    lengths = [5, 300, 19, 20, 21, 4000]
    tokens = r.integers(0, 50, sum(lengths)).astype(np.uint64)
    left = np.concatenate([np.arange(n, 0, -1) for n in lengths])
    starts, counts, _, _, leads = pieces.cut(pieces.mixed(tokens), left, 20, 6)
    held = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts)])
    assert held.tolist() == np.flatnonzero(left >= 20).tolist()
    assert ((leads >= 0) & (leads <= 14)).all()


def test_rows_without_id_whose_checksums_clash_stay_apart(spark):
    """Two unlike texts of one CRC-32; only the one that is there twice loses its words."""
    seen, i = {}, 0
    while True:
        digits = hashlib.sha512(b"%d" % i).hexdigest()
        b = " ".join(digits[k : k + 4] for k in range(0, 120, 4))
        a = seen.setdefault(zlib.crc32(b.encode()), b)
        if a != b:
            break
        i += 1
    df = spark.createDataFrame([(None, a), (None, b), (1, b)], "doc_id long, text string")
    words = substring.removal_digests(df).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in words) == [("1", 0), ("None", 0), ("None", 30)]
    read = suffix.remove_repeated_strings(df).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in read) == [("1", 0), ("None", 0), ("None", len(b))]
