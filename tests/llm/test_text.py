"""Quality, near-duplicates, leaks, personal data: against brute force, and on odd rows."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, minhash, pii, quality

ODD = "doc_id bigint, text string, id string, print string, score string, leaked int, source string"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    texts = [None, "", " \n\t", "one two", "One  TWO", LONG, LONG, "a b c d e f g h", "a b c d e f g h"]
    rows = [(k, t, "x", None, "s", 1, None if k % 2 else "src") for k, t in enumerate(texts)]
    return [*rows, rows[7], (None, "a b c d e f g h", None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def smallest_reachable(ids, linked):
    top = {i: i for i in ids}

    def root(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            p, q = sorted((root(a), root(b)))
            top[q] = p
    return {i: root(i) for i in ids}


def test_components(spark):
    from riskloom.llm.graph import components

    path = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(50)] + [(7, 7), (None, 3), (500, 400)]
    found = dict(components(spark.createDataFrame(path, "a bigint, b bigint")).collect())
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 150)} == {100}
    assert found[500] == 400 and len(found) == 93
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_duplicates_against_brute_force(spark, tables):
    extra = [(900_000 + k, " ".join(f"x{(j * 7 + (j % 97 == k)) % 991}" for j in range(120))) for k in range(60)]
    docs = tables("documents").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    near = minhash.Near(block_rows=16)  # several blocks a bucket
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)

    truth = smallest_reachable(list(sets), linked)
    rows = minhash.near_duplicates(docs, near=near).collect()
    assert {r.id: r.component_id for r in rows} == truth
    assert all(r.n_shingles == len(sets[r.id]) and r.kept == (r.id == r.component_id) for r in rows)
    assert len(set(truth.values())) < len(truth) - 20


def numbered_words(seed, n=120, pool=991):
    draw = np.random.default_rng(seed)
    return [f"v{x}" for x in draw.integers(0, pool, n)]


def changed(words, at):
    return " ".join([*words[:at], "changed", *words[at + 1 :]])


def test_an_id_with_two_texts(spark):
    """Texts are what is linked: near copies of both texts of an id are found, and nothing else."""
    one, two = numbered_words(1), numbered_words(2)
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, changed(one, 50)), (3, changed(two, 60)), (4, " ".join(numbered_words(3)))]
    rows += [(9, " ".join(one)), (9, " ".join(numbered_words(4))), (8, " ".join(numbered_words(4))), (7, " ".join(numbered_words(5)))] + [(7, " ".join(numbered_words(5)))] * 50
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows)
    assert {(r.id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 1), (9, 8), (8, 8), (7, 7)}
    groups = {(r.id, r.content): r.component for r in found}
    assert len(set(groups.values())) == 5


@pytest.mark.parametrize("block_rows", [8, 50])
def test_large_buckets(spark, block_rows):
    """Hundreds of near copies of a text, among them chains that don't link to its first copy, and
    others that only share much of it."""
    base_words, draw = numbered_words(6, 300), np.random.default_rng(6)
    rows = []
    for k in range(160):
        words = list(base_words)
        for at in draw.integers(0, 300, int(draw.integers(0, 6))):
            words[at] = f"n{k}"
        rows.append((k, " ".join(words)))
    for k in range(40):  # each a step further from the base
        words = list(base_words)
        words[: 5 * k] = [f"c{j}" for j in range(5 * k)]
        rows.append((500 + k, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)

    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), near=minhash.Near(block_rows=block_rows)).collect()
    assert {r.id: r.component_id for r in found} == smallest_reachable(list(sets), linked)


def test_near_duplicates_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    found = {r.id: r.component_id for r in rows if r.id is not None}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7}
    assert all(r.kept and r.component_id is None for r in rows if r.id is None)
    assert sorted(r.n_shingles for r in rows if r.id in (0, 1, 2, 3)) == [0, 0, 0, 1]
    assert minhash.near_duplicates(empty).collect() == []


def test_pruning_bound_keeps_its_promise():
    near = minhash.Near()
    need = minhash.least_matches(near)
    draws = np.random.default_rng(1).random((200_000, near.size)) < near.percent / 100
    alive = np.ones(len(draws), bool)
    for k, least in enumerate(need, 1):
        alive &= draws[:, : k * near.batch].sum(axis=1) >= least
    assert (~alive).mean() < 1e-3 and need == sorted(need)


def test_quality_ranks_the_held_out_fold(tables):
    docs, labels = tables("documents"), tables("labels")
    gam = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs.select("doc_id", "text"), gam)
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [[r.score for r in rows if r.quality == q] for q in (1, 0)]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    again = quality.fit_quality(docs.repartition(3), labels.repartition(2))
    assert again.base == gam.base and all((a == b).all() for a, b in zip(again.tables, gam.tables))
    # Labels inside the held-out fold change nothing.
    turned = labels.withColumn("quality", F.when(quality.in_fold(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert all((a == b).all() for a, b in zip(quality.fit_quality(docs, turned).tables, gam.tables))


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (7, 0), (None, 1), (5, None), (6, 1), (8, 0)], "doc_id bigint, quality int")
    for table in (labels, labels.limit(0), labels.where("quality = 1")):
        gam = quality.fit_quality(odd, table)
        rows = quality.score_quality(odd, gam).collect()
        assert len(rows) == len(odd_rows()) and all(0 < r.score < 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.score_quality(empty, gam).collect() == []


def test_leaks(spark, odd, empty):
    text = "Rivers carve deep valleys while patient glaciers polish ancient granite into smooth shining walls. The answer was forty slow moons."
    words, filler = text.split(), [f"q{k}" for k in range(300)]
    near = [w for k, w in enumerate(words) if k % 9 != 4]
    docs = [
        (1, " ".join([*filler[:100], *words, *filler[100:]])), (2, " ".join([*filler[:30], *near, *filler[30:]]).upper()),
        (3, " ".join(filler)), (4, " ".join([*filler, *words[:6]])), (5, "the answer was rivers walls moons " * 20), (6, None),
        (7, text), (8, " ".join(sorted(words))),
    ]
    docs += [(100 + k, " ".join(filler[k : k + 60])) for k in range(100)]
    bench = spark.createDataFrame([(70, text), (71, text), (72, None), (73, ""), (74, "too short"), (None, "x " * 30)], "item_id bigint, text string")
    rows = decontaminate.mark_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert {r.doc_id for r in rows if r.leaked} == {1, 2, 7} and {r.leak_item for r in rows if r.leaked} == {70}
    marked = decontaminate.mark_leaks(odd, bench)
    assert marked.count() == len(odd_rows()) and not any(r.leaked for r in marked.collect())
    assert decontaminate.mark_leaks(empty, bench).collect() == []
    assert not any(r.leaked for r in decontaminate.mark_leaks(odd, bench.limit(0)).collect())


def test_short_items_are_whole_sentences(spark):
    bench = spark.createDataFrame([(1, "What is DNA?"), (2, "Yes. No."), (3, "what IS dna"), (None, "Maybe"), (5, "a b c d e f g")], "item_id bigint, text string")
    docs = {
        1: "Some text. What is DNA? More.", 2: "He asked what is DNA? Then left.", 3: "oh\nyes. No!\nend", 4: "Yes. Perhaps. No.",
        5: "Maybe.", 6: "x a b c d e f g", 7: "x\na b, c d e f g", 8: "WHAT IS DNA", 9: None, 10: "",
    }
    marked = decontaminate.mark_leaks(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), bench)
    assert {r.doc_id: r.leak_item for r in marked.where("leaked").collect()} == {1: 1, 3: 2, 7: 5, 8: 1}


def test_leaks_against_a_dense_search(spark, tables):
    """Every item along every document, at every quarter of its length."""
    leaks, docs, bench = decontaminate.Leaks(), tables("documents").select("doc_id", "text"), tables("benchmark")
    items = [(r.item_id, decontaminate.words_of(r.text), decontaminate.answer_of(r.text)) for r in bench.collect()]

    def leaked(text):
        words = decontaminate.words_of(text)
        for _, item, answer in items:
            for at in range(0, max(1, len(words)), max(1, len(item) // 4)):
                region = words[at : at + 2 * len(item)]
                share = decontaminate.common_subsequence(item, region) / len(item)
                if share >= leaks.most or share >= leaks.some and decontaminate.common_subsequence(answer, region) >= leaks.answer * len(answer):
                    return True
        return False

    want = {r.doc_id for r in docs.collect() if leaked(r.text)}
    assert {r.doc_id for r in decontaminate.mark_leaks(docs, bench).where("leaked").collect()} == want != set()


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for k, y in enumerate(b, 1):
                row[k] = old[k - 1] + 1 if x == y else max(old[k], row[k - 1])
        return row[-1]

    draw = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([b"%d" % x for x in draw.integers(0, 6, draw.integers(0, 20))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def fits(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        return {"email": True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if fits(kind, m.group())]
    return sorted(found)


def test_base_spans_against_plain_patterns(spark):
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(list("a1.@-+ 9%(2)é😀_05"), draw.integers(0, 60))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "x" * 50_000, "a." * 5_000, "1 " * 2_000, "4111 1111-1111 1111, +1 (212) 555-0100"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    spans = pii.base_spans(F.coalesce("text", F.lit("")))
    for r in df.select("k", spans.alias("s"), pii.masked(F.col("text"), spans).alias("m")).collect():
        assert [tuple(s) for s in r.s] == base(texts[r.k])
        if r.s:
            assert not base(r.m) or len(base(r.m)) < len(r.s) or "[" in r.m
        else:
            assert r.m == texts[r.k]


def found_plainly(docs, how):
    """Found spans a document, from patterns and scores in dictionaries."""
    token = r"[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*"
    hits = []
    for doc, text in docs:
        known = base(text)
        for m in re.finditer(rf"(?<![^\x20\x09-\x0D]){token}(?:\x20{token})*", text or ""):
            core = re.match(r"([^\w+@]|_)*(.*?)([^\w]|_)*$", m[0], re.S)
            at, end = m.start() + core.start(2), m.start() + core.end(2)
            if at == end:
                continue
            shape = re.sub("[0-9]+", lambda d: "#" * (1 + (len(d[0]) > 1) + (len(d[0]) > 3) + (len(d[0]) > 7)), re.sub(r"[^\W\d_]+", "a", core[2]))
            sort = "address" if "@" in core[2] else "led" if core[2][0] == "+" else "mixed" if re.search(r"[^\W\d_]", core[2]) else "digits"
            before, after = (re.sub("[0-9]", "0", t.lower()).split() for t in (text[: m.start()], text[m.end() :]))
            b, w, a = before[-1:], before[-2:-1], after[:1]
            patterns = [("before", shape, *b)] * len(b) + [("after", shape, *a)] * len(a)
            patterns += [("two", sort, *w, *b)] * len(w) + [("both", sort, *b, *a)] * bool(b and a)
            seen = any(s < end and e > at for s, _, e in known)
            hits += [(doc, at, end, core[2], seen, p) for p in patterns]
    seed = {h[3] for h in hits if h[4]}
    of = {}
    for h in hits:
        of.setdefault(h[5], set()).add(h[3])
    score = {h[3]: float(h[3] in seed) for h in hits}
    for _ in range(how.rounds):
        strong = {p: sum(score[t] for t in ts) / (len(ts) + how.smoothing) for p, ts in of.items() if len(ts & seed) >= how.least_seeds}
        strong = {p: c for p, c in strong.items() if c >= how.confidence}
        for t in score:
            if t not in seed:
                score[t] = 1 - np.prod([1 - min(c, 1 - 1e-9) for p, c in strong.items() if t in of[p]])
    out = {doc: set() for doc, _ in docs}
    for doc, at, end, text, seen, p in hits:
        if not seen and text not in seed and p in strong and score[text] >= how.confidence:
            out[doc].add((at, 4, end))
    return out


def planted_identifiers():
    """(document, text) and the documents with an identifier that no base pattern matches."""
    draw = np.random.default_rng(4)
    docs = [(k, f"pass key{k:03d}@corp.io end") for k in range(40)] + [(100 + k, f"call badge +1 212 555 {1000 + k} now") for k in range(40)]
    docs += [(200 + k, f"from host 10.0.{k}.7 at noon, page {k} of 90") for k in range(40)]
    wanted = [(300, "pass key777@corp end"), (301, "then call badge +1 212 555 99 now"), (302, "seen from host 10.0.999.7 at night"), (303, "pass x5@y end")]
    others = [(400, "other key778@corp finish"), (401, "call badge 17 now"), (402, "page 17 of 20"), (403, "pass 55 end"), (404, None), (405, "")]
    noise = [(500 + k, " ".join(str(x) for x in draw.choice(["ab", "cd", "7", "x9", "2024", "a@b", "the"], 30))) for k in range(30)]
    return docs + wanted + others + noise, {d for d, _ in wanted}


def test_found_identifiers(spark, odd, empty):
    docs, wanted = planted_identifiers()
    how = pii.Bootstrap()
    rows = pii.find_private(spark.createDataFrame(docs, "doc_id bigint, text string"), how=how).collect()
    assert all([s for s in r.all_spans if s.kind < 4] == r.base_spans for r in rows)
    found = {r.doc_id: {tuple(s) for s in r.all_spans if s.kind == 4} for r in rows}
    found = {d: {(a, k, e) for a, k, e in spans} for d, spans in found.items()}
    assert found == found_plainly(docs, how)
    assert {d for d, spans in found.items() if spans} == wanted  # all of them, and nothing else
    text = dict(docs)
    assert {text[d][a:e] for d in wanted for a, _, e in found[d]} == {"key777@corp", "+1 212 555 99", "10.0.999.7", "x5@y"}
    rows = pii.find_private(odd).collect()
    assert len(rows) == len(odd_rows()) and rows[0].asDict().keys() >= set(odd.columns)
    assert pii.find_private(empty).collect() == []
