"""Personal data: fixed base patterns, and contextual patterns bootstrapped from their matches.

1. Base kinds are found by regular expressions with exact code point offsets: the matches
   and the pieces between them give the position of each match.
2. Every run of tokens that hold a digit or an @ is a candidate. It has a shape (letters
   and digits by classes of run lengths) and a sort (with an @, led by a +, digits alone,
   mixed). Its lexical patterns are its shape with the word before or after it, and its
   sort with the two words before it or with the words on both sides.
3. Patterns and instances (the candidates' texts) form a graph. Base matches are the
   seeds, with score 1. In rounds, a pattern's confidence is the smoothed mean score of
   its distinct instances, and an unseen instance's score is the noisy-or of its
   patterns' confidence; only patterns with enough seeds count.
4. Occurrences of unseen instances under a confident pattern are added as kind ``found``.

Only Spark SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_out

KINDS = ("email", "ip", "card", "phone", "found")
# Each starts a match where the plain pattern would: at the head of a run, or where the
# last match ended. Possessive repeats change no match, for nothing that follows could
# use what they hold; they keep long texts linear and the matcher's stack flat.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
RUN = 512
SPACE = r"\x20\x09-\x0D"
TOKEN = rf"[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
CANDIDATE = rf"(?<![^{SPACE}]){TOKEN}(?:\x20{TOKEN})*+"


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    least_seeds: int = 10
    confidence: float = 0.9
    smoothing: float = 1.0
    context_chars: int = 40


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str, chars: int = 0) -> Column:
    """array<struct<start, text, left, right>> of all matches, ``start`` in code points.

    ``left`` and ``right`` are up to ``chars`` characters around a match, no further than
    the next match on either side. Starts are a running sum of lengths, added up in runs
    of ``RUN`` matches, so that a text with very many matches copies no long array often.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    kind = "array<struct<start:int,text:string,left:string,right:string>>"
    none = F.expr(f"cast(array() as {kind})")

    def around(p: Column) -> Column:
        def hit(m: Column, i: Column) -> Column:
            gap, behind = F.get(p["g"], i), F.get(p["g"], i + 1)
            before = F.concat(F.coalesce(F.get(p["m"], i - 1), F.lit("")), gap) if chars else F.lit("")
            after = F.concat(behind, F.coalesce(F.get(p["m"], i + 1), F.lit(""))) if chars else F.lit("")
            left = F.substring(before, F.greatest(F.length(before) - chars, F.lit(0)) + 1, F.lit(chars))
            return F.struct(
                F.length(gap).alias("skip"), F.length(m).alias("size"), m.alias("text"), left.alias("left"),
                F.substring(after, F.lit(1), F.lit(chars)).alias("right"),
            )

        return F.transform(p["m"], hit)

    def place(hits: Column) -> Column:
        def add(a: Column, h: Column) -> Column:
            start = a["at"] + h["skip"]
            found = F.struct(start.alias("start"), h["text"], h["left"], h["right"])
            return F.struct((start + h["size"]).alias("at"), F.concat(a["out"], F.array(found)).alias("out"))

        def run(a: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(hits, k * RUN + 1, F.lit(RUN)), F.struct(a["at"].alias("at"), none.alias("out")), add)
            return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], r["out"]).alias("out")))

        runs = F.sequence(F.lit(0), ((F.size(hits) - 1) / RUN).cast("int"))
        return F.when(
            F.size(hits) > 0, F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("out")), run, lambda a: a["out"])
        ).otherwise(none)

    return _let(_let(parts, around), place)


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    value = F.transform(back, lambda x, i: F.coalesce(x.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        bare = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.length(p) < 4) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> by start, then kind (its place in ``KINDS``)."""
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        spans = F.transform(F.filter(located(text, PATTERNS[kind]), _test(kind)), _span(k))
        gate = needs.get(kind, text.rlike("[0-9]"))
        parts.append(F.when(gate, spans).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))
    return F.array_sort(F.concat(*parts))


def _test(kind: str):
    return lambda h: _passes(kind, h["text"])


def _span(k: int):
    return lambda h: F.struct(
        h["start"].alias("start"), F.lit(k).alias("kind"), (h["start"] + F.length(h["text"])).alias("end")
    )


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.concat_ws(",", said)


def candidates(text: Column, chars: int) -> Column:
    """array<struct<start, end, text, shape, sort, before, wider, after>> of the runs of tokens
    with a digit or an @; ``wider`` is the word before ``before``."""
    word = rf"([^{SPACE}]+)"

    def about(h: Column) -> Column:
        core = F.regexp_extract(h["text"], r"^[^\p{L}\p{N}+@]*(.*?)[^\p{L}\p{N}]*$", 1)
        lead = F.length(F.regexp_extract(h["text"], r"^([^\p{L}\p{N}+@]*)", 1))
        # The length of a run is told as 1, up to 3, up to 7, or more; letters first, for they put none of their own in.
        shape = F.regexp_replace(core, r"\p{L}+", "a")
        for pattern, said in ((r"\p{N}{8,}", "9999"), (r"(?<!\p{N})\p{N}{4,7}(?!\p{N})", "999"), (r"(?<!\p{N})\p{N}{2,3}(?!\p{N})", "99")):
            shape = F.regexp_replace(shape, pattern, said.replace("9", "#"))
        shape = F.regexp_replace(shape, r"\p{N}", "#")
        sort = (
            F.when(core.contains("@"), "address").when(core.startswith("+"), "led")
            .when(core.rlike(r"\p{L}"), "mixed").otherwise("digits")
        )

        def plain(x: Column) -> Column:
            return F.regexp_replace(F.lower(x), r"\p{N}", "0")

        # A word that the context's bound cuts is no word.
        left = F.when(F.length(h["left"]) < chars, F.concat(F.lit(" "), h["left"])).otherwise(h["left"])
        return F.struct(
            (h["start"] + lead).alias("start"), (h["start"] + lead + F.length(core)).alias("end"), core.alias("text"),
            shape.alias("shape"), sort.alias("sort"), plain(F.regexp_extract(left, rf"[{SPACE}]{word}[{SPACE}]*$", 1)).alias("before"),
            plain(F.regexp_extract(left, rf"[{SPACE}]{word}[{SPACE}]+[^{SPACE}]+[{SPACE}]*$", 1)).alias("wider"),
            plain(F.regexp_extract(h["right"], rf"^[{SPACE}]*{word}", 1)).alias("after"),
        )

    kind = "array<struct<start:int,end:int,text:string,shape:string,sort:string,before:string,wider:string,after:string>>"
    found = F.transform(located(text, CANDIDATE, chars), about)
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda c: c["text"] != "")).otherwise(F.expr(f"cast(array() as {kind})"))


def _occurrences(rows: DataFrame) -> DataFrame:
    c = F.col("c")
    seen = F.exists("base", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))

    def pattern(name: str, *parts: Column) -> Column:
        whole = F.concat_ws("\t", F.lit(name), *parts)
        for p in parts:
            whole = F.when(p != "", whole)
        return whole

    patterns = F.array(
        pattern("before", c["shape"], c["before"]), pattern("after", c["shape"], c["after"]),
        pattern("two", c["sort"], c["wider"], c["before"]), pattern("both", c["sort"], c["before"], c["after"]),
    )
    return (
        rows.select("row", "base", F.explode("candidates").alias("c"))
        .select("row", c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), seen.alias("seen"), F.explode(F.array_compact(patterns)).alias("pattern"))
    )


def learn_patterns(rows: DataFrame, how: Bootstrap) -> DataFrame:
    """(pattern, confidence, text, score): the edges of the graph under confident patterns."""
    edges = write_out(_occurrences(rows).groupBy("pattern", "text").agg(F.max("seen").alias("seen")), "edges")
    known = edges.groupBy("text").agg(F.max("seen").alias("seed"))
    edges = write_out(edges.join(known, "text").select("pattern", "text", "seed"), "edges")
    score = edges.select("text", "seed").distinct().withColumn("score", F.col("seed").cast("double"))
    for _ in range(how.rounds):
        strength = (
            edges.join(score.select("text", "score"), "text").groupBy("pattern")
            .agg((F.sum("score") / (F.count("*") + how.smoothing)).alias("confidence"), F.sum(F.col("seed").cast("int")).alias("seeds"))
            .where((F.col("seeds") >= how.least_seeds) & (F.col("confidence") >= how.confidence))
        )
        strength = write_out(strength.select("pattern", "confidence"), "patterns")
        held = F.log1p(-F.least(F.col("confidence"), F.lit(1 - 1e-9)))
        doubt = edges.join(strength, "pattern").groupBy("text").agg(F.sum(held).alias("doubt"))
        score = write_out(
            score.select("text", "seed").join(doubt, "text", "left")
            .withColumn("score", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.coalesce("doubt", F.lit(0.0))))).drop("doubt"),
            "scores",
        )
    return edges.where(~F.col("seed")).join(strength, "pattern").join(score.select("text", "score"), "text").where(
        F.col("score") >= how.confidence
    ).select("pattern", "text")


def find_private(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, how: Bootstrap = Bootstrap()) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), ``base_spans`` and ``all_spans``.

    Spans are structs (start, kind, end), kind being the place in ``KINDS``, by start, then
    kind. Null texts count as empty and have none. Base spans never depend on other rows;
    found ones come from all documents. Repeated rows stay, each with its own spans, and an
    empty table gives an empty result. Columns named ``base_spans`` or ``all_spans`` are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base_spans", "all_spans")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = write_out(
        docs.select(
            F.struct(*keep).alias("doc"), F.monotonically_increasing_id().alias("row"), base_spans(text).alias("base"),
            candidates(text, how.context_chars).alias("candidates"),
        ),
        "private",
    )
    learnt = learn_patterns(rows, how)
    added = (
        _occurrences(rows).where(~F.col("seen")).join(learnt, ["pattern", "text"])
        .groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("added"))
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return rows.select("doc", "row", "base").join(added, "row", "left").select(
        *[F.col(f"doc.{c}").alias(c) for c in keep], F.col("base").alias("base_spans"),
        F.array_sort(F.concat("base", F.coalesce("added", none))).alias("all_spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap become one,
    of the first's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def apart(a: Column, s: Column) -> Column:
        last, end = F.element_at(a["out"], -1), F.greatest(a["at"], s["end"])
        longer = F.array(F.struct(last["start"].alias("start"), last["kind"].alias("kind"), end.alias("end")))
        merged = F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), longer)
        return F.struct(end.alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(s))).otherwise(merged).alias("out"))

    kind = "array<struct<start:int,kind:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))

    def joined(kept: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            end = F.when(i > 0, F.get(kept, i - 1)["end"]).otherwise(0)
            return F.concat(F.substring(text, end + 1, s["start"] - end), F.element_at(names, s["kind"] + 1))

        last = F.element_at(kept, -1)["end"]
        return F.concat(F.array_join(F.transform(kept, piece), ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _let(F.aggregate(spans, start, apart, lambda a: a["out"]), joined)).otherwise(text)
