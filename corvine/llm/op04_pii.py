"""Operator 4, PII: bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the entities that the base patterns find in every whole text. Candidates are all words with a digit or
an at sign; a candidate's lexical pattern is the two whole words before it, digits as 0, lower-cased. The graph between patterns
and instances (one edge per distinct pair, with its count) is scored in turn: a pattern's confidence is the mean score of its
instances, damped by PRIOR; an instance's score is 1 for a seed, else the noisy-or of its patterns. After ROUNDS rounds the
patterns with at least MIN_INSTANCES distinct instances and a confidence of MIN_CONFIDENCE extract the unseen identifiers in
their slot (kind ``context``): candidates with an at sign or at least MIN_DIGITS digits. Base spans stay as they are.

One pass over the texts: what it finds (spans, candidates) is written to the shared folder, and all else reads that.
Edges are summed per task before the shuffle; joins on a pattern have one row per pattern on one side, so hot ones can be
split by adaptive execution; finds meet their rows by the row's number, never by its text or id. Matches are placed by the lengths of the matches and of the parts between them,
which split() and regexp_extract_all() give in code points. Sums and maxima along the matches of a text, and the look-up of spans and pieces by
place, go by blocks of the square root of their number, so a text with n matches costs n ** 1.5 steps at most; a task holds one text with its matches.

Defined results: a null text is an empty text; null or repeated ids do no harm, each row is judged by itself; texts of any length are read whole; an empty table
gives an empty table; other columns are carried by ``redact`` as they are, whatever their names (names that begin with two underscores are its own), and not looked at otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table

ROUNDS, PRIOR, MIN_INSTANCES, MIN_CONFIDENCE, MIN_DIGITS = 3, 1.0, 4, 0.75, 4

#: The base patterns. A match starts where no match could have started one character
#: earlier, or where the last one ended, so failing runs are read once; that leaves the matches as they are.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "context")
#: What a text must hold for a pattern to match at all; cheaper to look for.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
#: Tests of a match x.t.
VALID = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> coalesce(try_cast(p as bigint) <= 255, false))",
    "card": f"length({DIGITS}) between 14 and 19 and aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + case when i % 2 = 1 then ascii(substr({DIGITS}, -i, 1)) - 48 else (ascii(substr({DIGITS}, -i, 1)) - 48) * 2 - if(ascii(substr({DIGITS}, -i, 1)) >= 53, 9, 0) end) % 10 = 0",
    "phone": f"length({DIGITS}) between 10 and 15",
}


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_parts(text: str, pattern: str, hint: str = "") -> tuple[Column, Column]:
    """Matches in text and the parts between them; none for most texts, after one look."""
    p = literal(pattern)
    some = (f"instr({text}, {literal(hint)}) > 0 and " if hint else "") + f"{text} rlike {p}"
    none = "cast(array() as array<string>)"
    return F.expr(f"if({some}, regexp_extract_all({text}, {p}, 0), {none})"), F.expr(f"if({some}, split({text}, {p}, -1), {none})")


def blocks(array: str) -> str:
    """SQL for an array in blocks of the square root of its size."""
    size = f"greatest(1, cast(ceil(sqrt(size({array}))) as int))"
    return f"transform(sequence(0, greatest(0, size({array}) - 1) div {size}), i -> slice({array}, i * {size} + 1, {size}))"


def with_running(df: DataFrame, arrays: dict[str, str], step: Callable[[str, str], str]) -> DataFrame:
    """df with a column for each of ``arrays`` (name: SQL of an array of ints): what ``step`` (SQL of two values, associative, 0 neutral) makes
    of the values before each place."""
    along = lambda array, value: f"aggregate({array}, array(0), (o, v) -> concat(o, array({step('element_at(o, -1)', value)})))"
    out = df.withColumns({f"__v_{k}": F.expr(v) for k, v in arrays.items()})
    out = out.withColumns({f"__b_{k}": F.expr(f"transform({blocks(f'__v_{k}')}, b -> {along('b', 'v')})") for k in arrays})
    out = out.withColumns({f"__o_{k}": F.expr(along(f"__b_{k}", "element_at(v, -1)")) for k in arrays})
    whole = {k: F.expr(f"flatten(zip_with(__b_{k}, slice(__o_{k}, 1, size(__b_{k})), (b, o) -> transform(slice(b, 1, size(b) - 1), v -> {step('o', 'v')})))") for k in arrays}
    return out.withColumns(whole).drop(*[f"__{x}_{k}" for x in "vbo" for k in arrays])


def with_places(df: DataFrame, kinds: list[str]) -> DataFrame:
    """df, which has the matches __f_k and the parts between them __p_k of each kind, with __at_k: array of (s, e, t), start, end and text of each match."""
    taken = {f"__s_{k}": f"zip_with(__f_{k}, slice(__p_{k}, 1, size(__f_{k})), (f, p) -> length(f) + length(p))" for k in kinds}
    out = with_running(df, taken, lambda a, x: f"{a} + {x}")
    each = {f"__at_{k}": F.expr(f"transform(__f_{k}, (f, i) -> struct(__s_{k}[i] + length(__p_{k}[i]) as s, __s_{k}[i] + length(__p_{k}[i]) + length(f) as e, f as t))") for k in kinds}
    return out.withColumns(each).drop(*taken)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base: array of (s, rank, e, t) by start, then kind; __text is the text, never null."""
    out = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    for k, p in PATTERNS.items():
        found, parts = match_parts("__text", p, HINT[k])
        out = out.withColumns({f"__f_{k}": found, f"__p_{k}": parts})
    out = with_places(out, list(PATTERNS))
    each = [f"transform(filter(__at_{k}, x -> {VALID[k]}), x -> struct(x.s as s, {i} as rank, x.e as e, x.t as t))" for i, k in enumerate(PATTERNS)]
    out = out.withColumn("__base", F.expr(f"array_sort(concat({', '.join(each)}))"))
    return out.drop(*[f"__{x}_{k}" for x in ("f", "p", "at") for k in PATTERNS])


def candidates(docs: DataFrame) -> DataFrame:
    """docs (with __text, __base) and __seen: array of (s, e, token, pattern, seed)."""
    found, parts = match_parts("__text", CANDIDATE)
    out = with_places(docs.withColumns({"__f_word": found, "__p_word": parts}), ["word"])
    # the last two words of each part, the last one first, spelt backwards; a part before a candidate ends in white space
    tail = r"slice(filter(slice(split(reverse(p), '[\\x20\\x09-\\x0D]+', 4), 1, 3), w -> w <> ''), 1, 2)"
    out = out.withColumn("__tails", F.expr(f"transform(__p_word, p -> {tail})"))
    none = "cast(array() as array<string>)"
    before = f"slice(concat(__tails[i], if(i > 0, array(reverse(get(__f_word, i - 1))), {none}), if(i > 0, get(__tails, i - 1), {none}), if(i > 1, array(reverse(get(__f_word, i - 2))), {none})), 1, 2)"
    pattern = f"array_join(transform(reverse({before}), w -> lower(translate(reverse(w), '123456789', '000000000'))), ' ')"
    token = r"regexp_replace(x.t, '^[^A-Za-z0-9+@]++|(?<![^A-Za-z0-9@])[^A-Za-z0-9@]++$', '')"
    out = out.withColumn("__slots", F.expr(f"transform(__at_word, (x, i) -> struct(x.s as s, x.e as e, {token} as token, {pattern} as pattern))"))
    near = "transform({blocks}, c -> struct(c as c, filter(__base, b -> b.s < element_at(c, -1).e and b.e > c[0].s) as b))".format(blocks=blocks("__slots"))
    out = out.withColumn("__near", F.expr(f"if(size(__slots) = 0, null, {near})"))
    # an entity of several words is one instance, in the slot of its first word
    meets = "get(filter(g.b, b -> b.s < x.e and b.e > x.s), 0)"
    out = out.withColumn("__met", F.expr(f"flatten(transform(__near, g -> transform(g.c, x -> struct(x as x, {meets} as b))))"))
    seen = "transform(filter(__met, m -> m.b is null or m.b.s >= m.x.s), m -> struct(m.x.s as s, m.x.e as e, coalesce(m.b.t, m.x.token) as token, m.x.pattern as pattern, m.b is not null as seed))"
    return out.withColumn("__seen", F.expr(seen)).drop("__f_word", "__p_word", "__at_word", "__tails", "__slots", "__near", "__met")


def pattern_scores(edges: DataFrame) -> DataFrame:
    """edges (pattern, token, seed as 0/1; distinct pattern and token) -> pattern, confidence, instances."""
    scores = edges.groupBy("token").agg(F.max("seed").cast("double").alias("score"))
    last = None
    for k in range(ROUNDS):
        told = edges.join(scores, "token").groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(PRIOR))).alias("confidence"), F.count("*").alias("instances"))
        told = materialize(told, "pii-patterns")
        if last is not None:
            release(last)
        last = told
        if k + 1 < ROUNDS:
            heard = edges.join(told.where(F.col("instances") >= MIN_INSTANCES), "pattern", "left")
            noisy = 1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))
            scores = heard.groupBy("token").agg(F.when(F.max("seed") == 1, 1.0).otherwise(noisy).alias("score"))
    return told


def find_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with __base and __spans: arrays of (s, rank, e); rank indexes KINDS. One row per row."""
    base = F.expr("transform(__base, x -> struct(x.s, x.rank, x.e))").alias("__base")
    seen = candidates(base_spans(docs, text)).select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("__row"), base, F.coalesce("__seen", F.expr("slice(__seen, 1, 0)")).alias("__seen"))
    seen = materialize(seen, "pii-scan")
    each = seen.select("__row", F.explode("__seen").alias("c")).select("__row", "c.*")
    good = each.where("pattern <> '' and token <> ''")
    edges = materialize(good.groupBy("pattern", "token").agg(F.max(F.col("seed").cast("int")).alias("seed")), "pii-edges")
    taken = pattern_scores(edges).where((F.col("instances") >= MIN_INSTANCES) & (F.col("confidence") >= MIN_CONFIDENCE)).select("pattern")
    release(edges)
    new = good.where(f"not seed and (contains(token, '@') or length(regexp_replace(token, '[^0-9]', '')) >= {MIN_DIGITS})").join(taken, "pattern", "left_semi")
    new = new.groupBy("__row").agg(F.collect_list(F.struct("s", F.lit(len(PATTERNS)).alias("rank"), "e")).alias("__new"))
    out = seen.join(new, "__row", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "__base", F.expr("array_sort(concat(__base, coalesce(__new, slice(__base, 1, 0))))").alias("__spans"))


def span_text(column: str) -> str:
    names = ", ".join(literal(k) for k in KINDS)
    return f"array_join(transform({column}, x -> concat(element_at(array({names}), x.rank + 1), ':', x.s, ':', x.e)), ',')"


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the personal data in their texts replaced by <KIND>; all other columns as they are. A null text stays null. Of
    spans that overlap, the first stands for all."""
    names = ", ".join(literal(f"<{k.upper()}>") for k in KINDS)
    out = with_running(find_pii(docs, docs.columns, text), {"__done": "transform(__spans, x -> x.e)"}, lambda a, x: f"greatest({a}, {x})")
    out = out.withColumn("__kept", F.expr("filter(zip_with(__spans, __done, (x, d) -> struct(d as d, x.s as s, x.rank as rank)), x -> x.s >= x.d)"))
    out = out.withColumn("__parts", F.expr(f"if(size(__kept) = 0, null, transform({blocks('__kept')}, c -> struct(c as c, substring(`{text}`, c[0].d + 1, element_at(c, -1).s - c[0].d) as t)))"))
    pieces = f"flatten(transform(__parts, g -> transform(g.c, x -> concat(substring(g.t, x.d - g.c[0].d + 1, x.s - x.d), element_at(array({names}), x.rank + 1)))))"
    out = out.withColumn(text, F.expr(f"if(__parts is null, `{text}`, concat(array_join({pieces}, ''), substring(`{text}`, array_max(transform(__spans, x -> x.e)) + 1)))"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind and the digests of the spans for docs (doc_id, text)."""
    found = find_pii(docs, ["doc_id"])
    counts = [f"cast(size(filter(__base, x -> x.rank = {i})) as long) n_{k}" for i, k in enumerate(PATTERNS)]
    return found.selectExpr("doc_id", *counts, "cast(size(__spans) - size(__base) as long) n_context", f"sha2({span_text('__base')}, 256) base_sha256", f"{span_text('__spans')} spans")


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
