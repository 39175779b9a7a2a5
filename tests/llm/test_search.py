"""Repeated passages, spelling variants, hard negatives: against brute force, and on odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import negatives, repeats, spelling

from test_text import ODD, odd_rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


# Repeated passages


def removed(texts, width=35):
    """(words, removed, digest) a text, by comparing word sequences."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(v for v, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


#: Parts and slices small enough that even small tables have several.
SMALL = repeats.Repeats(part_bytes=60_000, slice_windows=5_000)


@pytest.mark.parametrize("cells", [4, 1])  # with few cells most windows get through the sketch
def test_repeats_against_brute_force(spark, tables, cells):
    docs = tables("documents").select("doc_id", "text")
    rows = docs.collect()
    want = {r.doc_id: x for r, x in zip(rows, removed([r.text for r in rows]))}
    setting = repeats.Repeats(part_bytes=60_000, slice_windows=5_000, cells=cells)
    found = repeats.remove_repeats(docs, repeats=setting).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == want
    assert sum(r.n_removed for r in found) > 0


def test_repeats_edges(spark):
    draw = np.random.default_rng(2)

    def fresh(n):
        return [f"u{x}" for x in draw.integers(0, 1 << 40, n)]

    passage = fresh(35)
    texts = [
        " ".join(fresh(50) + passage + fresh(3)), "\t".join(fresh(1) + passage),  # exactly one window
        " ".join(fresh(40) + passage[:34] + fresh(40)), " ".join(passage[:34]),  # one word short
        " ".join(["la"] * 36), " ".join(["lo"] * 35),  # overlapping itself; a lone window
        " ".join([*passage[:20], passage[20].upper(), *passage[21:]]),  # words count as they are
        "é  x " * 20, None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.id: r for r in repeats.remove_repeats(docs, repeats=SMALL).collect()}
    assert [(found[k].n_words, found[k].n_removed, found[k].kept_sha256) for k in range(len(texts))] == removed(texts)
    assert [found[k].n_removed for k in range(7)] == [35, 35, 0, 0, 36, 0, 0]
    kept = docs.join(repeats.remove_repeats(docs, repeats=SMALL).withColumnRenamed("id", "doc_id"), "doc_id")
    said = dict(repeats.kept_text(kept, "doc_id").collect())
    assert said[1] == texts[1].split("\t")[0] and said[8] == "" and said[3] == texts[3]


def test_repeats_on_odd_rows(spark, odd, empty):
    texts = [r[1] for r in odd_rows()]
    found = repeats.remove_repeats(odd).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(removed(texts))
    assert sum(r.id is None for r in found) == 2
    assert repeats.remove_repeats(empty).collect() == []


def test_windows_hold_over_chunks(monkeypatch):
    import pyarrow as pa

    texts = pa.chunked_array([[" ".join(f"w{k}" for k in range(900)), "a b", None, " ".join(f"w{k}" for k in range(300, 700))]])
    whole = repeats._windows(texts, 35, True)
    monkeypatch.setattr(repeats, "_CHUNK", 64)
    cut = repeats._windows(texts, 35, True)
    assert (whole.first == cut.first).all() and (whole.second == cut.second).all()
    assert len(whole.starts) == 866 + 366 and len(set(whole.first.tolist())) == 866


def test_packed_numbers_come_back():
    draw = np.random.default_rng(3)
    for numbers in ([], [0], [5, 5, 9], draw.integers(0, 1 << 63, 1000), draw.integers(0, 300, 999)):
        ordered = np.sort(np.array(numbers, np.uint64))
        assert (repeats._unpack(repeats._pack(ordered)) == ordered).all()


# Spelling variants


def variants(docs, least=3, length=5, modulus=97):
    """word: (form, root, n, n_near, form_n), by making every edit of every word."""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= least and len(w) >= length}
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [v for v in edits if v in n and v != w]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def as_found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def planted(seed=4):
    """Chains of words, each an edit from the next and half as frequent; accents; long runs."""
    draw, rows = np.random.default_rng(seed), []
    for k in range(40):
        word = "".join(draw.choice(list("abcdeé"), 7))
        for step in range(5):
            rows += [f"{word} Ä"] * 2 ** (6 - step)
            at = int(draw.integers(0, len(word)))
            word = [word[:at] + word[at + 1 :], word[:at] + "z" + word[at:], word[:at] + "y" + word[at + 1 :]][step % 3]
    rows += ["x" * 200 + "y"] * 8 + ["x" * 201] * 3 + ["x" * 200] * 3 + ["ÀÉÎÕÜ àéîõü Ābcdef ××××××"] * 4
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1024, 8])  # the small one deals keys over many blocks
def test_spelling_against_brute_force(spark, tables, block):
    rows = planted() + [(10_000 + r.doc_id, r.text) for r in tables("documents").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = variants(rows)
    assert as_found(spelling.group_spellings(docs, spelling=spelling.Spelling(block=block))) == want
    depth = sum(form is not None and root != form for form, root, *_ in want.values())
    assert depth > 20 and any(len(w) > 64 for w in want)


def test_one_edit():
    words = [bytes(w) for n in range(4) for w in itertools.product(b"abc", repeat=n)]
    for a, b in itertools.product(words, words):
        near = b in {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + bytes([c]) + a[i:] for i in range(len(a) + 1) for c in b"abc"}
        near |= b in {a[:i] + bytes([c]) + a[i + 1 :] for i in range(len(a)) for c in b"abc"} - {a}
        assert spelling.one_edit(a, b) == near
        if a and b and len(a) <= len(b):
            width = max(len(a), len(b)) + 1
            letters = np.array([list(w.ljust(width, b"\0")) for w in (a, b)], np.uint8)
            got = spelling._verified(letters, np.array([len(a), len(b)]), np.array([0]), np.array([1]))
            assert a == b or len(b) > len(a) + 1 or bool(got[0]) == near


def test_spelling_on_odd_rows(spark, odd, empty):
    assert spelling.group_spellings(empty).collect() == [] and spelling.group_spellings(odd).collect() == []
    rows = [(None, "Colour"), (None, "colour"), (3, "colour colour COLOUR colour colour"), (4, "color"), (4, "color"), (None, "color"), (5, None), (6, "")]
    found = as_found(spelling.group_spellings(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert found == variants(rows) and found["color"][0] == "colour"


# Hard negatives

VECTORS = "vec_id bigint, embedding array<double>, label int, a int, data string, row int, dim int"


def mined(rows, every=50):
    """What each row of the result must be, in Python integers."""
    out, sound = [], []
    for k, (i, v, label, *_) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            sound.append((k, i, [int(np.floor(256 * x)) for x in v], label))
    for k, i, v, label in sound:
        if i is None or i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j is None, j, m == label) for n, j, w, m in sound if n != k and len(w) == len(v)]
        others.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        for score, _, j, _ in [x for x in others if x[3]][:5]:
            fits = [x for x in others if not x[3] and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out += [(i, j, rank, x[2], -score, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out, key=repr)


def found_rows(df, **setting):
    return sorted((tuple(r) for r in negatives.mine_negatives(df, mine=negatives.Mine(**setting)).collect()), key=repr)


def clustered(count=1500, dim=24, seed=6):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, dim))
    kind = draw.choice(12, count, p=[0.4, *[0.6 / 11] * 11])
    v = centres[kind] + 0.4 * draw.standard_normal((count, dim))
    v[::9] = v[0]  # many copies of one vector
    label = np.where(draw.random(count) < 0.35, 0, (kind + draw.integers(0, 3, count)) % 10)
    return [(k, [float(x) for x in row], int(c), 1, "d", 2, 3) for k, (row, c) in enumerate(zip(v, label))]


@pytest.mark.parametrize("setting", [{}, {"block_rows": 64, "anchor_rows": 7, "blocks_a_task": 3}])
def test_negatives_against_brute_force(spark, setting):
    rows = clustered()
    assert found_rows(spark.createDataFrame(rows, VECTORS), **setting) == mined(rows) != []


def test_bounds_hold_and_save_work():
    rows = [r for r in clustered(3000, 32, 8) if r[0] % 9]
    v = np.floor(256 * np.array([r[1] for r in rows]))
    known = negatives._directions([(32, r[1]) for r in rows[:1000]], negatives.Mine())
    out = np.zeros(len(v), negatives._record(32, 8))
    out["v"], out["norm"] = v, np.sqrt((v * v).sum(axis=1))
    out["angles"] = np.arccos(np.clip((v / out["norm"][:, None]) @ known[32].T, -1, 1))
    anchors = out[::50]
    low, high = negatives._bounds(anchors, out)
    score = negatives._scores(anchors, out)
    assert (low <= score).all() and (score <= high).all()
    fifth = np.partition(score, -6, axis=1)[:, -6]
    assert (high >= fifth[:, None]).mean() < 0.5  # over half of all pairs need no score


def test_negatives_in_whole_numbers(spark):
    draw = np.random.default_rng(9)
    rows = [(k, [float(x) for x in draw.integers(1, 1 << 22, 3)], k % 2, 1, "d", 2, 3) for k in range(120)]  # scores beyond 2^53
    assert found_rows(spark.createDataFrame(rows, VECTORS)) == mined(rows) != []


def test_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [(k, [1.0, k / 100, -0.5], k % 3, 1, "d", 2, 3) for k in range(101)]
    odd = [
        (200, None, 1, None, None, None, None), (250, [1.0, None, 2.0], 1, 1, "d", 1, 1), (300, [1.0, nan, 2.0], 1, 1, "d", 1, 1),
        (350, [1.0, inf, 2.0], 1, 1, "d", 1, 1), (400, [1.0, 2.0, 3.0], None, 1, "d", 1, 1), (None, [1.0, 0.3, -0.5], 0, 1, "d", 1, 1),
        (450, [0.0, 0.0, 0.0], 1, 1, "d", 1, 1), (500, [], 1, 1, "d", 1, 1), (550, [], 2, 1, "d", 1, 1), (600, [2.0], 2, 1, "d", 1, 1),
        (650, [1.0], 1, 1, "d", 1, 1), (700, [1.0], 2, 1, "d", 1, 1), base[50], base[51],
    ]
    assert found_rows(spark.createDataFrame(base + odd, VECTORS)) == mined(base + odd)
    assert found_rows(spark.createDataFrame([], VECTORS)) == []
    assert found_rows(spark.createDataFrame(odd[:5], VECTORS)) == []


def test_relabelled(spark):
    rows = [(7, 9), (8, 9), (14, 3), (None, 3), (21, None)]
    assert [r.label for r in negatives.relabelled(spark.createDataFrame(rows, "vec_id bigint, label int")).collect()] == [0, 9, 4, 3, None]
