"""Mixing, vectors, pages, urls, fixity, tokens and the pipeline."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import html, mixing, pivots, tokens, urls, warc

from test_text import ODD, odd_rows, smallest_reachable


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def targets(sizes, weights=(5, 2, 1), limit=3):
    """Shares by weight; what is above a limit is cut off and shared by the others."""
    total, fixed = sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        rest = total - sum(fixed.values())
        weight = sum(weights[k % 3] for k in free)
        share = {k: rest * weights[k % 3] / weight for k in free}
        over = [k for k in free if share[k] > limit * sizes[k]]
        if not over:
            return {**fixed, **share}
        fixed |= {k: limit * sizes[k] for k in over}


def test_mix(spark):
    draw = np.random.default_rng(5)
    sources = [None if s == 6 else f"s{s}" for s in draw.choice(7, 3000, p=[0.5, 0.02, 0.2, 0.08, 0.1, 0.05, 0.05])]
    rows = [(k, " ".join(["w"] * int(n)), s) for k, (n, s) in enumerate(zip(draw.integers(0, 60, 3000), sources))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(docs, block_docs=4, shard_words=12_000)
    found = mixed.toPandas()
    assert len(found) == 3000
    by = found.groupby("source", dropna=False).agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    by = by.reset_index().sort_values("source", na_position="last")
    assert (by["size"] == by.told).all()
    assert np.allclose(list(dict(sorted(targets(by["size"].tolist()).items())).values()), by.target)
    assert (abs(by.taken - by.target) <= 30).all()
    assert (found.taken == found["size"] * found.shards.map(len)).all() and (found.taken <= 3 * found["size"]).all()
    again = mixing.mix(docs.repartition(5), block_docs=4, shard_words=12_000).toPandas()
    assert sorted(zip(found.id, found.shards.map(tuple))) == sorted(zip(again.id, again.shards.map(tuple)))
    placed = mixing.arrange(mixed).toPandas()
    assert len(placed) == found.shards.map(len).sum()
    for _, shard in placed.groupby("shard"):
        assert sorted(shard.position) == list(range(1, len(shard) + 1))
    # Every shard is a fair sample: its share of the hot source is near the whole's.
    share = placed.assign(hot=placed.source == "s0").groupby("shard").hot.mean()
    assert abs(share - (placed.source == "s0").mean()).max() < 0.3


def test_hypergeometric(spark):
    n, k, m = 30, 12, 10
    u = (F.col("id") + 0.5) / 20_000
    rows = spark.range(20_000).select(mixing._hypergeometric(F.lit(n), F.lit(k), F.lit(m), u).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in rows:
        assert abs(r["count"] / 20_000 - comb(k, r.x) * comb(n - k, m - r.x) / comb(n, m)) < 2e-4
    assert sum(r["count"] for r in rows) == 20_000
    quotas = spark.createDataFrame([(1, 500), (2, 40), (3, 1)], "place bigint, units bigint")
    split = mixing.split_quotas(quotas, 4, 7).toPandas()
    assert split.groupby("place").quota.sum().to_dict() == {1: 500, 2: 40, 3: 1}
    assert set(split.groupby("shard").quota.sum()) <= {33, 34} and split.shard.nunique() == 16


def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows()) and all(r.taken == 0 for r in rows if not r.size)
    assert mixing.mix(empty).collect() == []
    assert mixing.arrange(mixing.mix(empty)).collect() == []


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(40, 16))
    x = np.concatenate([c + draw.normal(size=(n, 16)) * 0.06 for c, n in zip(centres, draw.integers(1, 40, 40))]).astype(np.float32)
    rows = [(k, v.tolist(), int(k % 3)) for k, v in enumerate(x)]
    rows += [(10_000 + k, rows[5][1], rows[5][2]) for k in range(5)]
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(close, False)
    at = {r[0]: k for k, r in enumerate(rows)}
    truth = smallest_reachable(list(at), lambda a, b: close[at[a], at[b]])
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for how in (pivots.Pivots(block_rows=8), pivots.Pivots(points=16, prefix=6, shared=2)):
        found = {r.id: r for r in pivots.near_vectors(table, how=how).collect()}
        links = sum(r.n_links for r in found.values())
        assert all(r.n_links <= close[at[k]].sum() for k, r in found.items())
        assert links >= 0.95 * close.sum()
    found = {r.id: r for r in pivots.near_vectors(table).collect()}
    assert np.mean([found[k].component_id == c for k, c in truth.items()]) > 0.95
    assert {found[10_000 + k].n_links for k in range(5)} == {found[5].n_links} and found[5].n_links >= 5


def test_vectors_odd_rows(spark):
    kind = "vec_id bigint, embedding array<float>, label int, id string, unit int, n int, grp int"
    vectors = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0, 0.0], [1e-30, 0.0]]
    rows = [(k, v, 1, None, 1, 1, 1) for k, v in enumerate(vectors)] + [(20, [1.0, 0.0], None, "x", 1, 1, 1), (None, [1.0, 0.0], 1, "x", 1, 1, 1)]
    found = pivots.near_vectors(spark.createDataFrame(rows + [rows[6]], kind)).collect()
    by = {r.id: (r.n_links, r.component_id, r.kept) for r in found}
    assert len(found) == 13 and by[6] == (2, 6, True) and by[7] == (2, 6, False) and by[9] == (2, 6, False)
    assert all(by[k] == (0, k, True) for k in (0, 1, 2, 3, 4, 5, 8, 20)) and by[None] == (0, None, True)
    assert pivots.near_vectors(spark.createDataFrame([], kind)).collect() == []


def test_main_text(spark):
    tree = html.trained()
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site">Top <b>site</b></header>
    <div id="cookie-banner"><p>We use cookies on this site to make all of it better for everyone.</p></div>
    <main><article><header><h1>Title &amp; more</h1></header><p>First <a href="x">linked</a> para&nbsp;with   spaces.<br>next</p>
    <div class="ad">Buy now!</div><p>x < y and a &lt; b</p><p data-x="a>b">One<script>var t="</p>";</script> two
    <section id="comments"><p>Nice text, I like this very much indeed.</p></section></article></main>
    <aside><p>Side text long enough to be something like real text.</p></aside><form><label>Mail</label></form><footer>f</footer></body></html>"""
    want = "Title & more\nFirst linked para with spaces. next\nx < y and a < b\nOne two"
    assert html.main_text(page, tree) == want
    rows = [(1, "u", page, "old"), (2, None, None, None), (3, "u", "", "x"), (4, "u", "<article><p>cut off in a <b", None), (4, "u", "<p" * 50_000, None)]
    rows += [(5, "u", "<article>" + "<p>word word</p>" * 20_000, None), (5, "u", "<article>" + "<p>word word</p>" * 20_000, None), (6, "u", "</div></p>&amp; <!-- a", None)]
    kind = "page_id int, url string, html string, text string"
    found = html.extract(spark.createDataFrame(rows, kind)).collect()
    assert [r.text for r in found[:4]] == [want, "", "", "cut off in a"] and found[5].text == found[6].text == "\n".join(["word word"] * 20_000)
    assert html.extract(spark.createDataFrame([], kind)).collect() == []


@pytest.mark.parametrize("group", [256, 5, 2])
def test_quotas_of_many_sources(spark, group):
    """Split in groups, and in groups of groups: quotas hold exactly, shards are even and fair."""
    draw = np.random.default_rng(3)
    units = {k + 1: int(n) for k, n in enumerate(draw.integers(0, 40, 30))} | {31: 3000}
    quotas = spark.createDataFrame(list(units.items()), "place bigint, units bigint")
    rows = mixing.split_quotas(quotas, 4, 9, group).toPandas()
    assert rows.groupby("place").quota.sum().to_dict() == {k: n for k, n in units.items() if n}
    shards = rows.groupby("shard").quota.sum()
    assert len(shards) == 16 and shards.max() - shards.min() <= 2
    total, hot = sum(units.values()), rows[rows.place == 31].set_index("shard").quota
    share = units[31] / total
    spread = (shards.mean() * share * (1 - share)) ** 0.5
    assert (abs(hot - shards * share) < 5 * spread).all() and hot.std() > 0.2 * spread
    again = mixing.split_quotas(quotas.repartition(3), 4, 9, group).toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, rows.values))


def test_mix_of_repeated_rows(spark):
    """Hundreds of equal rows are dealt like any others, and reruns agree."""
    rows = [(7, "one two three", "a")] * 400 + [(None, "x y", "b")] * 300 + [(k, "w " * (k % 9), "c") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(docs, block_docs=4, shard_words=500)
    a, b = ([(r.id, r.source, r.size, r.target, r.taken) for r in m.collect()] for m in (found, mixing.mix(docs.repartition(7), block_docs=4, shard_words=500)))
    assert sorted(a, key=repr) == sorted(b, key=repr) and len(a) == 1000
    frame = found.toPandas()
    assert frame.draw.nunique() == 1000
    for _, part in frame.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()


def labelled_blocks(pages):
    """(features, labels) of pages that are lists of (label, piece)."""
    xs, ys = [], []
    for page in pages:
        ends = [len(html.blocks("".join(piece for _, piece in page[:k]))) for k in range(len(page) + 1)]
        xs.append(html.features(html.blocks("".join(piece for _, piece in page))))
        ys += [label for (label, _), a, b in zip(page, ends, ends[1:]) for _ in range(b - a)]
    return np.concatenate(xs), np.array(ys)


def test_main_text_tree_on_held_out_pages():
    tree = html.trained()
    x, y = labelled_blocks(html.labelled_pages(100, seed=99))
    assert (tree.predict(x) == y).mean() > 0.98 and 0.3 < y.mean() < 0.8
    used = {html.FEATURES[n[0]] for n in tree.nodes if n[0] >= 0}
    assert used >= {"words", "links", "links_before"} and used & {"words_before", "words_after", "links_after"}
    flags = [html.FEATURES.index(f) for f in ("article", "part", "hint", "heading", "sentence")]
    bare = x.copy()
    bare[:, flags] = 0  # without any flag, sizes and links still tell most blocks
    assert (tree.predict(bare)[x[:, flags[2]] + x[:, flags[1]] == 0] == y[x[:, flags[2]] + x[:, flags[1]] == 0]).mean() > 0.9


def test_main_text_of_unusual_pages():
    tree = html.trained()
    words = "the council met on monday to discuss plans for a new bridge across the river and heard both sides before it agreed to go on with the work at once. "
    article = f"<article><p>{words}</p></article>"
    kept = words.strip()
    for page in (f"<body class='post has-sidebar'>{article}</body>", f"<div class='content no-comments'>{article}</div>", f"<main id=search>{article}</main>", f"<p>{words}</p>"):
        assert html.main_text(page, tree) == kept
    plain = f"<div><p>{words}</p></div><div><p>Yes.</p></div><div><p>{words[:70]}.</p></div>"
    assert html.main_text(plain, tree).split("\n") == [kept, "Yes.", words[:70].strip() + "."]
    links = "".join(f"<li><a href=/{k}>see page {k}</a></li>" for k in range(5))
    assert html.main_text(f"<article><p>{words}</p><ul>{links}</ul><p>{words}</p></article>", tree) == f"{kept}\n{kept}"
    hidden = f"<article><p>{words}</p><div style='display:none'><p>{words}</p></div><section class=comments><div><p>{words}</p></div></section></article>"
    assert html.main_text(hidden, tree) == kept


def test_main_text_of_deep_and_unclosed_pages():
    found = html.blocks("<div>" * 200_000 + "a" + "</p>" * 200_000 + "<p>b" + "</div>" * 200_000 + "c")
    assert [b.text for b in found] == ["a", "b", "c"]


def test_urls(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    cases = {
        "http://A.Example.NET/en/5?x": ("a.example.net", "/en/5", "example.net/en/", "allow"), "http://x.net/de": ("x.net", "/de", "net/", "block"),
        "http://x.net": ("x.net", "", None, None), "https://badexample.com/de/": ("badexample.com", "/de/", None, None),
        "https://example.com/de/1#a": ("example.com", "/de/1", "example.com/de/", "block"), "a.net/x": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "ftp://ÄB.org/fr/": ("Äb.org", "/fr/", "org/fr/", "allow"), "x://y://z.net/a": ("y:", "//z.net/a", None, None),
    }
    kind = "page_id int, url string, host int, verdict int, _shape int"
    rows = [(k, u, 1, None, 2) for k, u in enumerate(cases)] + [(99, "http://x.net/de", 1, 1, 1)] * 3
    found = urls.judge(spark.createDataFrame(rows, kind), rules).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ((verdict,) if verdict else ("allow", "block"))
    assert urls.judge(spark.createDataFrame([], kind), rules).collect() == []


def judged_plainly(given, rules, how=urls.Templates()):
    """(template, purity, labels, verdict) a url, from a tree of dictionaries."""

    def split(url):
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        parts = [re.sub("[0-9]+", "{n}", re.sub("[0-9A-Fa-f-]{16,}", "{code}", p)) for p in path.split("/")][1:]
        head, tail = parts[: how.depth], parts[how.depth :]
        hits = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return host, tuple(head + ["/".join(tail)] * bool(tail)), max(hits)[2] if hits else None

    def kind(shape, level):
        if level >= len(shape):
            return "$"
        return re.sub("w([-_+. ]w)+", "w-w", re.sub(r"[^\W\d_]+", "w", shape[level]))

    def smooth(group, base):
        n, b = sum(x[2] is not None for x in group), sum(x[2] == "block" for x in group)
        return (b + how.smoothing * base) / (n + how.smoothing)

    def grow(group, level, template, purity, out):
        """``group``: the urls of a node."""
        done, on = [x for x in group if len(x[1]) <= level], [x for x in group if len(x[1]) > level]
        if done:
            out[template] = (purity, {x[1] for x in done}, sum(x[2] is not None for x in done), sum(x[2] == "block" for x in done))
        children, named = {x[1][level] for x in on}, {}
        kinds = Counter(kind(x[1], level + 1) for x in on)
        labelled = [x for x in on if x[2]]
        p = sum(x[2] == "block" for x in labelled) / len(labelled) if labelled else None
        for c in children:
            mine = [x for x in on if x[1][level] == c]
            chi = sum((k * len(mine) / len(on) - sum(kind(x[1], level + 1) == name for x in mine)) ** 2 / (k * len(mine) / len(on)) for name, k in kinds.items())
            free = len(kinds) - 1
            known = [x for x in mine if x[2]]
            apart = known and abs(sum(x[2] == "block" for x in known) / len(known) - p) > how.z * (p * (1 - p) / len(known)) ** 0.5 + 1e-12
            if len(children) > how.many and len(on) / len(children) <= how.rare:
                name = "*"
            elif chi <= free + how.z * (2 * free) ** 0.5 + 1e-9 and not apart:
                name = "~"
            else:
                name = c
            named.setdefault(name, []).extend(mine)
        for name, part in named.items():
            grow(part, level + 1, f"{template}/{name}", smooth(part, purity), out)

    rows = [split(u) for u in given]
    base, out = smooth(rows, 0) * 0 + (sum(x[2] == "block" for x in rows) / max(1, sum(x[2] is not None for x in rows))), {}
    domains = {".".join(x[0].split(".")[-2:]) for x in rows}
    for d in domains:
        inside = [x for x in rows if ".".join(x[0].split(".")[-2:]) == d]
        top, wide = smooth(inside, base), {}
        grow(inside, 0, "", top, wide)
        for h in {x[0] for x in inside}:
            own = [x for x in inside if x[0] == h]
            made = {}
            grow(own, 0, "", smooth(own, top), made)
            for t, (purity, shapes, n, b) in made.items():
                for s in shapes:
                    w, _, m, _ = next(v for v in wide.values() if s in v[1])
                    if n < how.least and m >= how.least:
                        purity = (b + how.smoothing * w) / (n + how.smoothing)
                    out[h, s] = t, purity, n if n >= how.least else max(n, m)
    for u, (h, s, hit) in zip(given, rows):
        t, purity, n = out[h, s]
        yield u, t, round(purity, 9), n, hit or ("block" if purity >= how.reject and n >= how.least else "allow")


def url_sample(seed=7):
    draw = np.random.default_rng(seed)
    out = []
    for h in ("a.shop.io", "b.shop.io", "c.shop.io", "www.news.org", "blog.news.org", "x.y"):
        for k in range(80):
            top = draw.choice(["deals", "about", "p", "en", "de", "fr", "x-y"])
            rest = {"deals": f"/{k}/buy.html", "about": "", "p": f"/{k}", "x-y": f"/some-words-{k}/z/{k}/q/r/s"}.get(str(top), f"/{'abcdefgh'[k % 8]}{'ijklmnop'[k // 10]}/{k}")
            out.append(f"https://{h}/{top}{rest}")
    return out + [f"http://wide.io/{'abcdefghijklmnop'[k % 16]}{'qrstuv'[k // 16]}z" for k in range(90)]


def test_url_tree_against_a_plain_one(spark):
    rules = [("a.shop.io/deals/", "block"), ("b.shop.io/deals/", "block"), ("shop.io/about", "allow"), ("news.org/de/", "block"), ("www.news.org/en/", "allow"), ("wide.io/a", "block")]
    given = url_sample()
    judged = urls.judge(spark.createDataFrame([(u,) for u in given], "url string"), rules).collect()
    found = Counter((r.url, r.template, round(r.purity, 9), r.labels, r.verdict) for r in judged)
    assert found == Counter(judged_plainly(given, rules))
    assert {r.template.split("/")[1] for r in judged if r.host == "wide.io"} == {"*"}


def test_url_templates_of_a_domain_judge_its_hosts(spark):
    """Spam pages of two listed hosts are told on a third, and nothing else there is."""
    rules = [("a.shop.io/deals/", "block"), ("b.shop.io/deals/", "block"), ("a.shop.io/about/", "allow")]
    rows = [(f"http://{h}.shop.io/{t}",) for h in "abc" for k in range(12) for t in (f"deals/{k}/buy.html", f"about/us/{'abcdefghijkl'[k]}/x")]
    rows += [(f"http://new.example/deals/{k}/buy.html",) for k in range(12)]  # a domain without any label
    found = urls.judge(spark.createDataFrame(rows, "url string"), rules).collect()
    assert {r.verdict for r in found if "c.shop.io/deals" in r.url} == {"block"}
    assert {r.verdict for r in found if "/about/" in r.url or "new.example" in r.url} == {"allow"}
    assert {r.labels for r in found if "c.shop.io/deals" in r.url} == {24}


def test_urls_without_rules(spark):
    found = urls.judge(spark.createDataFrame([("http://a.b/c",), (None,), ("http://a.b/" + "d/" * 5000,)], "url string"), []).collect()
    assert [r.verdict for r in found] == ["allow"] * 3 and {r.rule for r in found} == {None}


def test_fixity(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" * (k % 5)) for k in range(300)] + [(7, "http://x/7b", "twice"), (None, None, None), (301, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    first = warc.warc_records(pages, per_file=64)
    assert warc.audit(first, first).collect() == []
    other = pages.where("page_id is null or page_id not in (5, 299)").withColumn("html", F.expr("case when page_id in (7, 100) then concat(html, '!') else html end"))
    other = other.unionByName(spark.createDataFrame([(5_000, "u", "h")], other.schema))
    found = {r.id: r.state for r in warc.audit(first, warc.warc_records(other, per_file=64)).collect()}
    assert found == {5: "missing", 299: "missing", 7: "changed", 100: "changed", 5_000: "extra"}
    nothing = first.limit(0)
    assert warc.audit(nothing, nothing).collect() == [] and warc.audit(first, nothing).count() == 301
    for (file,), _ in itertools.groupby(sorted({(r.file,) for r in first.collect()})):
        records = sorted((r for r in first.collect() if r.file == file), key=lambda r: r.offset)
        (tmp_path / f"{file}.warc").write_bytes(b"".join(bytes(r.record) for r in records))
    read = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.uri, bytes(r.body)) for r in read) == sorted((u or "", (h or "").encode()) for _, u, h in rows)


def replica(spark, rows):
    """Records in files one after another: (file, id, bytes)."""
    at, out = Counter(), []
    for file, i, record in rows:
        out.append((i, file, at[file], len(record), bytearray(record)))
        at[file] += len(record)
    return spark.createDataFrame(out, "id bigint, file int, offset bigint, length bigint, record binary")


def test_fixity_sees_places(spark):
    """Moved, shortened and swapped records, sparse ids, files that are missing."""
    rows = [(k // 40, (k * 7919) << 30, b"%d" % k * 700) for k in range(200)]  # ids of 40 bits, ranges of few records
    first = replica(spark, rows)
    swapped = list(rows)
    swapped[3], swapped[90] = (0, rows[90][1], rows[90][2]), (2, rows[3][1], rows[3][2])
    shorter = [(f, i, r[:-1] if k == 50 else r) for k, (f, i, r) in enumerate(rows)]
    damaged = [(f, i, b"x" + r[1:] if k == 120 else r) for k, (f, i, r) in enumerate(rows)]
    ids = [i for _, i, _ in rows]

    def states(other, moved=False):
        return Counter((r.id, r.state) for r in warc.audit(first, replica(spark, other), moved).collect())

    assert states(damaged, True) == {(ids[120], "changed"): 1}
    assert states(shorter) == {(ids[50], "changed"): 1}
    assert states(shorter, True) == {(ids[50], "changed"): 1} | {(i, "moved"): 1 for i in ids[51:80]}
    assert states(swapped) == {} and {(ids[3], "moved"), (ids[90], "moved")} <= set(states(swapped, True))
    assert states(rows[:40] + rows[80:]) == {(i, "missing"): 1 for i in ids[40:80]}
    twice = rows[:10] + [rows[9]] * 3 + rows[10:]
    found = warc.audit(first, replica(spark, twice)).collect()
    assert [(r.id, r.state, r.length) for r in found] == [(ids[9], "extra", 3 * len(rows[9][2]))]


def test_fixity_reads_only_what_differs(spark):
    rows = [(k // 500, k, b"%05d" % k * 200) for k in range(4000)]
    one, two = (warc._leaves(replica(spark, [(f, i, b"!" + r[1:] if bad and i == 777 else r) for f, i, r in rows])) for bad in (False, True))
    a, b = warc.tree(one, 1), warc.tree(two, 1)
    assert a[0].count() > 8 * 7 and a[1].count() == 8
    assert warc._differing(a[0], b[0], ["file", "range"], None, []).count() == 1
    assert [x.first()[0] for x in (a[-1], b[-1])] == [0, 0] and a[-1].first().hash != b[-1].first().hash


def test_odd_warc_files(spark, tmp_path):
    import gzip

    def record(uri, body, length=None):
        size = len(body) if length is None else length
        return b"WARC/1.1\r\nWARC-Target-URI: %s\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n" % (uri, str(size).encode(), body)

    good = [record(b"http://a/", b"one"), record(b"http://\xff/", b"two"), record(b"http://c/", b"")]
    (tmp_path / "plain.warc").write_bytes(good[0] + b"junk\r\n\r\n" + good[1] + record(b"u", b"x", "many") + good[2] + record(b"v", b"tail", 99))
    (tmp_path / "zipped.warc.gz").write_bytes(b"".join(gzip.compress(g) for g in good))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(good[0]) + gzip.compress(good[1])[:-9])
    (tmp_path / "empty.warc").write_bytes(b"")
    found = warc.read_warc(spark, str(tmp_path)).collect()
    by = {n: [r for r in sorted(found, key=lambda r: r.offset) if r.path.endswith(n)] for n in ("plain.warc", "zipped.warc.gz", "cut.warc.gz", "empty.warc")}
    assert [(r.uri, r.problem) for r in by["plain.warc"]] == [
        ("http://a/", None), (None, "no record header"), ("http://\ufffd/", None), ("u", "no content length"), ("http://c/", None), ("v", "cut short")
    ]
    assert [bytes(r.body) for r in by["zipped.warc.gz"]] == [b"one", b"two", b""] and not any(r.problem for r in by["zipped.warc.gz"])
    assert by["cut.warc.gz"][0].body == b"one" and by["empty.warc"] == []


def test_token_attribution():
    ends = np.array([4, 9, 12])
    got, crossing = tokens.attribute(np.array([2, 3, 1, 2, 4]), ends)  # spans 0-2, 2-5, 5-6, 6-8, 8-12
    assert got.tolist() == [2, 2, 1] and crossing.tolist() == [1, 0, 1]
    got, crossing = tokens.attribute(np.array([12]), ends)
    assert got.tolist() == [0, 1, 0] and crossing.tolist() == [0, 1, 0]
    got, crossing = tokens.attribute(np.array([2, 4, 6]), np.array([4, 12]))  # a tie goes to the first
    assert got.tolist() == [2, 1] and crossing.tolist() == [1, 0]


def counted_plainly(own, text, boundary):
    """(section, start, end, tokens, crossing), token by token and byte by byte."""
    raw, ends = text.encode(), [m.end() for m in re.finditer(boundary, text.encode()) if m.end() > m.start()]
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    section = [next(k for k, e in enumerate(ends) if b < e) for b in range(len(raw))]
    tokens_of, crossing, at = Counter(), Counter(), 0
    for token in own.encode_ordinary(text):
        size = len(own.decode_single_token_bytes(token))
        held = Counter(section[at : at + size])
        owner = min(held, key=lambda k: (-held[k], k))
        tokens_of[owner] += 1
        crossing[owner] += len(held) > 1
        at += size
    starts = [0, *ends[:-1]]
    return [(k, len(raw[:a].decode()), len(raw[:b].decode()), tokens_of[k], crossing[k]) for k, (a, b) in enumerate(zip(starts, ends))]


def own_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.VOCABULARY), special_tokens={})


@pytest.mark.parametrize("boundary", [rb"\n", rb"\. ", rb"e"])
def test_token_counts_against_a_plain_version(spark, tables, boundary):
    own = own_encoding()
    docs = tables("documents").select("doc_id", "text").orderBy("doc_id").limit(25)  # a fixture: the plain version is slow
    for r in tokens.count_tokens(docs, boundary=boundary).collect():
        assert [tuple(s) for s in r.sections] == counted_plainly(own, r.text, boundary)


def test_long_blanks_change_no_token(monkeypatch):
    """Runs taken on their own give the tokens of the whole text, whatever stands around them."""
    own, draw = own_encoding(), np.random.default_rng(8)
    monkeypatch.setattr(tokens, "LONG_BLANK", 2)
    texts = ["a  b", "a \n b", "  a", "a  ", "   ", "it's  's \t\t9", "x\u3000\u3000\x85y", "a\x1c\x1cb", "..  ..\n\n", "é \n"]
    texts += ["".join(draw.choice(list(" \n\tab1.'sé\u2003"), 60)) for _ in range(3000)]
    for text in texts:
        assert tokens.encoded(own, text).tolist() == own.encode_ordinary(text)


def test_a_million_blanks(spark):
    rows = [(1, "a" + " " * 999_999 + "b"), (2, "\n" * 999_999), (3, "z" * 300_000)]
    found = {r.doc_id: r.sections for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found[1][0].end == 1_000_001 and len(found[2]) == 999_999
    assert sum(s.tokens for s in found[2]) > 0 and found[3][0].end == 300_000


def test_every_document_has_a_row(spark, tmp_path):
    from riskloom.llm.queries import QUERIES

    spark.createDataFrame([(1, None), (2, ""), (3, "a\nb"), (None, "c")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op9_tokens"](spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 3: 2, None: 1}
    assert all(r.section is None for r in rows if r.doc_id in (1, 2))


def test_token_counts(spark, tables, odd, empty):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.VOCABULARY), special_tokens={})
    docs = tables("documents").select("doc_id", "text")
    for boundary in (rb"\n", rb"[.!?]\s+"):
        for r in tokens.count_tokens(docs, boundary=boundary).collect():
            ids = own.encode_ordinary(r.text)
            assert sum(s.tokens for s in r.sections) == len(ids)
            assert "".join(r.text[s.start : s.end] for s in r.sections) == r.text
    rows = tokens.count_tokens(odd).collect()
    assert [len(r.sections) for r in rows[:4]] == [0, 0, 2, 1] and len(rows) == len(odd_rows())
    assert rows[5].sections[0].tokens == len(own.encode_ordinary(rows[5].text))
    assert tokens.count_tokens(empty).collect() == []


def test_pipeline_keeps_texts_that_share_an_id(spark):
    """One of each group of near copies stays, and every text that is like no other."""
    draw = np.random.default_rng(5)
    one, two, three = ([f"p{x}" for x in draw.integers(0, 9999, 150)] for _ in range(3))
    near = " ".join([*one[:70], "else", *one[71:]])
    texts = [(1, " ".join(one)), (1, " ".join(two)), (1, near), (2, near), (None, " ".join(one)), (None, " ".join(three)), (5, " ".join(two)), (5, " ".join(two)), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.near_duplicate(spark, docs, "").collect()
    groups = Counter("one" if r.text in (" ".join(one), near) else "two" if r.text == " ".join(two) else r.text for r in left)
    assert groups == {"one": 1, "two": 1, " ".join(three): 1, None: 1, "": 1}
    assert all(r.doc_id == 1 for r in left if r.text in (" ".join(one), near, " ".join(two)))


def test_pipeline_stages(spark, tables):
    folder = "/root/testdata/sf0.001"
    docs = tables("documents")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0)], docs.schema))
    docs = docs.withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select(*corpus_pipeline.COLUMNS).toPandas()
        out = stage(spark, docs, folder)
        after = out.toPandas()
        assert list(after.columns)[:5] == corpus_pipeline.COLUMNS
        if name == "PII":
            assert len(after) == len(before)
            assert not after.text.fillna("").str.contains(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", regex=True).any()
        elif name != "mixing sources":
            assert set(after.doc_id.dropna()) <= set(before.doc_id.dropna()) and len(after) <= len(before)
            docs = spark.createDataFrame(out.collect(), out.schema)
        nothing = stage(spark, docs.limit(0), folder)
        assert nothing.columns == out.columns and nothing.collect() == []
