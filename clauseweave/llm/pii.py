"""Personal data: fixed base patterns, and candidates of looser generators chosen by boosted trees.

Everything is a built-in function over one row: the matches of a pattern and the
pieces between them give every span's place, so texts neither shuffle nor leave
the JVM. The looser generators propose overlapping spans; their format and their
surroundings are the features of gradient-boosted trees, turned into one
expression and applied to every candidate. They are fitted on the candidates of
every text, counted by equal features: right are those that a base span covers, and base spans rewritten
into other forms where they stand; wrong are those that break the format of their
kind, found or rewritten. Found ones of a good format that no base span covers
are not learned from, as nobody knows what they are. Of those that score above
the calibrated threshold and touch no base span, the best of each place is added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseweave.llm.common import text_or_empty
from clauseweave.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive loops and the left edges that make long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: obfuscated or accented addresses, colon groups, other separators and lengths, numbers without a plus.
LOOSE = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[\p{L}0-9-]{1,64}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[\p{L}0-9-]{1,64}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:{1,2}){3,7}+[0-9A-Fa-f]{1,4}+|(?<![0-9])[0-9]{1,9}+(?:\x20?\.\x20?[0-9]{1,9}+){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,20}+",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[\x20.-]{1,2}+\(?[0-9]{2,5}+\)?){2,5}+",
}
#: A text without such a character has no match of either pattern.
NEEDED = {"email": r"@|at[\])]", "ip": r"[0-9A-Fa-f][.:\x20]", "card": r"[0-9]", "phone": r"[0-9]"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
CUES = r"(?i)(?:tel|phone|fax|call|mobil|card|visa|credit|mail|contact|addr|\bip\b|host)[^\n]{0,12}$"
FEATURES = ("kind", "length", "digits", "letters", "separators", "dots", "ats", "plus", "luhn", "octets", "left_edge", "right_edge", "cue", "groups", "format")
DATE = r"^(?:(?:19|20)[0-9]{2}[\x20.-]+[0-9]{1,2}[\x20.-]+[0-9]{1,2}|[0-9]{1,2}[\x20.-]+[0-9]{1,2}[\x20.-]+(?:19|20)[0-9]{2})$"
#: Other forms of a base span of value v and digits d: right ones, and such that break the format.
FORMS = {
    "email": (["replace(v, '@', ' [at] ')", "replace(v, '@', '(at)')", "replace(replace(v, '@', ' [at] '), '.', ' [dot] ')"], ["replace(v, '@', ' [at] ') || '.7'", "regexp_replace(replace(v, '@', '(at)'), '[^.]+$', '42')"]),
    "ip": (
        ["rtrim(':', regexp_replace(md5(v), '(.{4})', '$1:'))", "'fe80::' || rtrim(':', regexp_replace(substr(md5(v), 1, 16), '(.{4})', '$1:'))", "replace(v, '.', ' . ')"],
        ["rtrim(':', regexp_replace(substr(md5(v), 1, 12), '(.{2})', '$1:'))", "rtrim(':', regexp_replace(substr(md5(v), 1, 20), '(.{4})', '$1:'))", "'3' || lpad(substr(d, 1, 2), 2, '0') || replace(substr(v, instr(v, '.')), '.', ' . ')"],
    ),
    "card": (
        ["regexp_replace(d, '([0-9]{4})(?=[0-9])', '$1.')", "substr(d, 1, 4) || '.' || substr(d, 5, 6) || '.' || substr(d, 11)"],
        ["regexp_replace(substr(d, 1, length(d) - 1) || (int(right(d, 1)) + 1) % 10, '([0-9]{4})(?=[0-9])', '$1.')", "regexp_replace(d || d, '([0-9]{4})(?=[0-9])', '$1.')"],
    ),
    "phone": (
        ["substr(v, 2)", "'00' || substr(v, 2)", "regexp_replace(d, '^([0-9]{1,3}?)([0-9]{3})([0-9]{3,4})([0-9]{4})$', '$1 $2 $3 $4')", "regexp_replace(d, '^([0-9]+)([0-9]{3})([0-9]{4})$', '$1-$2-$3')", "regexp_replace(d, '^([0-9]*)([0-9]{3})([0-9]{3})([0-9]{4})$', '($2) $3-$4')"],
        ["'20' || substr(d, 1, 2) || '-0' || (1 + int(substr(d, 3, 1)) % 9) || '-1' || substr(d, 4, 1)", "substr(d, 1, 2) || '-' || substr(d, 3, 2) || '-' || substr(d, 5, 2)", "'1' || substr(d, 1, 1) || '.0' || (1 + int(substr(d, 3, 1)) % 9) || '.20' || substr(d, 4, 2)", "substr(v, 2) || ' ' || substr(d, 1, 4) || ' ' || substr(d, 1, 4)"],
    ),
}
#: Characters kept on each side of a base span that is rewritten.
AROUND = 40
#: Least precision of added spans on the held-out fifth of the candidates; trees, their depth and least bins of a feature.
LEAST_PRECISION, TREES, DEPTH, BINS = 0.995, 8, 3, 32
#: Partial sums of lengths are taken in runs of matches, surroundings from runs of the text, so that a text of very many matches stays linear.
RUN = 256


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _spans(df: DataFrame, pattern: str, needed: str, name: str) -> DataFrame:
    """Add the array ``name`` of (start, end, value) of every match, in code points."""
    found, pieces, steps, runs = f"_{name}_m", f"_{name}_p", f"_{name}_s", f"_{name}_r"
    has = F.col("text").rlike(needed)
    return (
        df.withColumn(found, F.when(has, F.expr(f"regexp_extract_all(text, {_literal(pattern)}, 0)")))
        .withColumn(pieces, F.when(F.size(found) > 0, F.expr(f"split(text, {_literal(pattern)}, -1)")))
        # Each step is what lies before a match and the match itself.
        .withColumn(steps, F.expr(f"zip_with(slice({pieces}, 1, size({found})), {found}, (p, m) -> bigint(length(p) + length(m)))"))
        .withColumn(runs, F.expr(f"transform(sequence(0, (size({steps}) - 1) div {RUN}), k -> aggregate(slice({steps}, k * {RUN} + 1, {RUN}), 0L, (a, x) -> a + x))"))
        .withColumn(runs, F.expr(f"transform({runs}, (r, k) -> aggregate(slice({runs}, 1, k), 0L, (a, x) -> a + x))"))
        .withColumn(
            name,
            F.expr(
                f"""coalesce(transform({found}, (m, i) -> named_struct(
                    'start', {runs}[i div {RUN}] + aggregate(slice({steps}, (i div {RUN}) * {RUN} + 1, i % {RUN} + 1), 0L, (a, x) -> a + x) - length(m),
                    'end', {runs}[i div {RUN}] + aggregate(slice({steps}, (i div {RUN}) * {RUN} + 1, i % {RUN} + 1), 0L, (a, x) -> a + x),
                    'value', m)), cast(array() AS array<struct<start:bigint,end:bigint,value:string>>))"""
            ),
        )
        .drop(found, pieces, steps, runs)
    )


def _luhn(digits: str) -> str:
    """SQL for whether a string of digits passes the Luhn test; the string is computed once."""
    digit = "int(substr(d, i, 1))"
    value = f"CASE WHEN (length(d) - i) % 2 = 0 THEN {digit} ELSE int(substr('0246813579', {digit} + 1, 1)) END"
    return f"(transform(array({digits}), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + {value}))[0] % 10 = 0)"


def _only_digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _valid(kind: str, value: str) -> str:
    """SQL for the base rule on a match."""
    digits = _only_digits(value)
    return {
        "email": "true",
        "ip": f"{value} RLIKE {_literal(OCTETS)}",
        "card": f"(length({digits}) BETWEEN 16 AND 19 AND {_luhn(digits)})",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }[kind]


def _format(kind: str, value: str, digits: str, luhn: str) -> str:
    """SQL for whether a loose match has a format of its kind, given its digits and their Luhn test."""
    doubled = f"(length({value}) - length(replace({value}, '::', ''))) div 2"
    return {
        "email": rf"{value} RLIKE r'(?:\.|[\[(]dot[\])])\x20?\p{{L}}{{2,}}$'",
        "ip": f"(CASE WHEN contains({value}, ':') THEN {doubled} = 1 OR ({doubled} = 0 AND size(split({value}, ':')) = 8) ELSE replace({value}, ' ', '') RLIKE {_literal(OCTETS)} END)",
        "card": f"(length({digits}) BETWEEN 13 AND 19 AND {luhn})",
        "phone": f"(length({digits}) BETWEEN 8 AND 15 AND NOT {value} RLIKE {_literal(DATE)})",
    }[kind]


def _leading(spans: str, holds: str) -> str:
    """SQL for how many spans from the first on satisfy ``holds`` (of ``e``), which no later span does: a binary search."""
    at = "n + shiftleft(1, k)"
    element = f"get({spans}, {at} - 1)"
    return f"aggregate(sequence(length(bin(size({spans}))) - 1, 0, -1), 0, (n, k) -> n + CASE WHEN {at} <= size({spans}) AND {holds.replace('e.', element + '.')} THEN shiftleft(1, k) ELSE 0 END)"


def base_spans(docs: DataFrame) -> DataFrame:
    """Add an array of (start, end, value) for each kind to rows with a ``text``."""
    for kind in KINDS:
        docs = _spans(docs, BASE[kind], NEEDED[kind], f"base_{kind}")
        docs = docs.withColumn(f"base_{kind}", F.expr(f"filter(base_{kind}, s -> {_valid(kind, 's.value')})"))
    every = [F.expr(f"transform(base_{k}, s -> named_struct('order', {i}, 'kind', '{k}', 'start', s.start, 'end', s.end))") for i, k in enumerate(KINDS)]
    return docs.withColumn("base", F.concat(*every))


def candidates(docs: DataFrame) -> DataFrame:
    """Add ``candidates``: every loose match with its features and whether it touches a base span."""
    for kind in KINDS:
        docs = _spans(docs, LOOSE[kind], NEEDED[kind], f"loose_{kind}")
    every = ", ".join(f"transform(loose_{k}, s -> named_struct('order', {i}, 'name', '{k}', 'start', s.start, 'end', s.end, 'value', s.value))" for i, k in enumerate(KINDS))
    # Base spans of one kind never overlap, so the first that ends behind a candidate's start decides.
    touches = f"size(b) > 0 AND coalesce(get(b, {_leading('b', 'e.end <= s.start')}).start < s.end, false)"
    of_kind = f"array({', '.join(f'base_{k}' for k in KINDS)})"
    numbers = {
        "kind": "s.order",
        "length": "length(s.value)",
        "digits": "length(s.digits)",
        "letters": r"length(regexp_replace(s.value, r'[^\p{L}]', ''))",
        "separators": r"length(regexp_replace(s.value, r'[^\x20().-]', ''))",
        "dots": "length(regexp_replace(s.value, '[^.]', ''))",
        "ats": "length(regexp_replace(s.value, '[^@]', ''))",
        "plus": "int(startswith(s.value, '+'))",
        "luhn": "int(s.luhn)",
        "octets": f"int(s.value RLIKE {_literal(OCTETS)})",
        "left_edge": r"int(s.start = 0 OR NOT s.before RLIKE r'[\p{L}0-9]$')",
        "right_edge": r"int(s.after = '' OR NOT s.after RLIKE r'[\p{L}0-9]')",
        "cue": f"int(s.before RLIKE {_literal(CUES)})",
        "groups": "size(split(s.value, r'[^0-9]+'))",
        "format": f"int(CASE s.name {' '.join(f"WHEN '{k}' THEN {_format(k, 's.value', 's.digits', 's.luhn')}" for k in KINDS)} END)",
    }
    fields = ", ".join(f"'{n}', double({numbers[n]})" for n in FEATURES)
    place = "'order', s.order, 'name', s.name, 'start', s.start, 'end', s.end"
    # A place far inside a long text is slow to reach, so surroundings come from runs of the text.
    run = f"int(greatest(s.start - 24, 0) div {RUN})"
    near = f"concat(get(_runs, {run}), coalesce(get(_runs, {run} + 1), ''))"
    steps = [
        f"concat({every})",
        f"transform(_loose, s -> named_struct({place}, 'value', s.value, 'hits', transform({of_kind}, b -> {touches}), 'digits', {_only_digits('s.value')}, 'before', substr({near}, int(greatest(s.start - 24, 0) % {RUN}) + 1, int(least(s.start, 24))), 'after', coalesce(substr(get(_runs, int(s.end div {RUN})), int(s.end % {RUN}) + 1, 1), '')))",
        f"transform(_loose, s -> named_struct({place}, 'value', s.value, 'hits', s.hits, 'digits', s.digits, 'before', s.before, 'after', s.after, 'luhn', length(s.digits) > 1 AND {_luhn('s.digits')}))",
    ]
    runs = f"CASE WHEN {' OR '.join(f'size(loose_{k}) > 0' for k in KINDS)} THEN regexp_extract_all(text, r'(?s).{{1,{RUN}}}', 0) END"
    docs = docs.withColumn("_runs", F.expr(runs))
    for step in steps:
        docs = docs.withColumn("_loose", F.expr(step))
    made = f"transform(_loose, s -> named_struct({place}, 'right', get(s.hits, s.order), 'taken', array_contains(s.hits, true), {fields}))"
    return docs.withColumn("candidates", F.expr(made)).drop("_loose", "_runs", *[f"loose_{k}" for k in KINDS])


@dataclass(frozen=True)
class Selector:
    """SQL for a candidate's score, and the score from which it is added."""

    score: str
    threshold: float


NOTHING = Selector("0D", 1.0)


def _tree_sql(node) -> str:
    """A regression tree of the fitted ensemble as a CASE expression over a candidate ``c``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"CASE WHEN c.{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END"


def rewritten(found: DataFrame) -> DataFrame:
    """Base spans of ``found`` (doc_id, text, base spans) in other forms: doc_id, kind, good, text, at, to.

    Each form of a span is a row with a piece of its own text around it.
    """
    parts = []
    for kind, forms in FORMS.items():
        # Surroundings come from runs of the text, and no span carries its text: one text may have very many.
        first = f"greatest(s.start - {AROUND}, 0)"
        near = "concat(get(_runs, int({0} div {1})), coalesce(get(_runs, int({0} div {1}) + 1), ''))"
        before = f"substr({near.format(first, RUN)}, int({first} % {RUN}) + 1, int(least(s.start, {AROUND})))"
        after = f"coalesce(substr({near.format('s.end', RUN)}, int(s.end % {RUN}) + 1, {AROUND}), '')"
        held = found.where(F.size(f"base_{kind}") > 0).withColumn("_runs", F.expr(f"regexp_extract_all(text, r'(?s).{{1,{RUN}}}', 0)"))
        spans = held.select("doc_id", F.expr(f"transform(base_{kind}, s -> named_struct('v', s.value, 'before', {before}, 'after', {after}))").alias("s"))
        spans = spans.select("doc_id", F.explode_outer("s").alias("s"))
        pieces = spans.select("doc_id", "s.v", F.expr(_only_digits("s.v")).alias("d"), "s.before", "s.after")
        every = F.array(*[F.struct(F.lit(good).alias("good"), F.expr(f).alias("form")) for good, of in zip((True, False), forms, strict=True) for f in of])
        parts.append(pieces.withColumn("f", F.explode(every)).select("doc_id", F.lit(kind).alias("kind"), "f.good", F.concat("before", "f.form", "after").alias("text"), F.length("before").alias("at"), F.length(F.concat("before", "f.form")).alias("to")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def examples(docs: DataFrame) -> DataFrame:
    """Labelled candidates of ``docs`` (doc_id, text): fold, kind of the base span they were made from, taken, label, features.

    Of a rewritten span only a candidate of its kind and exact place is right;
    others in its place are wrong if the form or the kind is.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold")
    found = cut_lineage(candidates(base_spans(docs)))
    own = found.select(fold, F.lit(None).cast("string").alias("made"), F.explode_outer("candidates").alias("c")).filter("c.right OR c.taken OR c.format = 0")
    own = own.select("fold", "made", F.expr("c.taken").alias("taken"), F.expr("double(c.right)").alias("label"), *[F.col(f"c.{n}").alias(n) for n in FEATURES])
    # Outer explodes: a plain one makes the candidates again, match by match, to see whether there are any; a null falls to the filters.
    # Stored, or every step below would be planned once for each part of the union.
    pieces = cut_lineage(rewritten(found))
    made = candidates(base_spans(pieces)).select(fold, F.col("kind").alias("made"), "good", "at", "to", F.explode_outer("candidates").alias("c"))
    made = made.filter("NOT c.taken AND c.start < to AND at < c.end").withColumn("exact", F.expr("c.start = at AND c.end = to"))
    made = made.filter("exact OR NOT good OR c.name <> made").withColumn("label", F.expr("double(good AND exact AND c.name = made)"))
    return own.unionByName(made.select("fold", "made", F.expr("c.taken").alias("taken"), "label", *[F.col(f"c.{n}").alias(n) for n in FEATURES]))


def fit(docs: DataFrame, texts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Selector:
    """Boosted trees over the candidates of every text that holds a digit or an at sign, or of at most ``texts`` of them.

    Candidates with equal features are one row with their number, so the trees and the
    threshold count every one of them. The threshold is the lowest score whose examples
    in the held-out fifth, without those that touch a base span, reach the least
    precision; without both classes nothing is ever added.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    if texts is not None:
        picked = rows.select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(texts).distinct()
        rows = rows.join(F.broadcast(picked), "doc_id").limit(2 * texts)
    table = cut_lineage(examples(rows).groupBy("fold", "taken", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")))
    counts = {r.label: r["count"] for r in table.filter("fold <> 0").groupBy("label").count().collect()}
    if len(counts) < 2:
        return NOTHING
    # The trees' cuts come from as many rows as the square of the bins: from all of them.
    bins = max(BINS, math.isqrt(sum(counts.values())) + 1)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table)
    booster = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=0.3, seed=7, weightCol="n")
    model = booster.fit(data.filter("fold <> 0").select("x", "label", "n"))
    trees = [f"{float(w)!r}D * ({_tree_sql(t._call_java('rootNode'))})" for t, w in zip(model.trees, model.treeWeights, strict=True)]
    score = f"1D / (1D + exp(-2D * ({' + '.join(trees)})))"
    held = table.filter("fold = 0 AND NOT taken").select(F.struct(*FEATURES).alias("c"), "label", "n")
    scored = held.select(F.round(F.expr(score), 6).alias("s"), "label", "n").groupBy("s").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).orderBy(F.desc("s")).collect()
    good = n = 0
    threshold = 1.1
    for row in scored:  # one row for each distinct leaf combination
        good, n = good + row.good, n + row.n
        if good / n >= LEAST_PRECISION:
            threshold = float(row.s)
    return Selector(score, threshold)


def personal_data(docs: DataFrame, selector: Selector = NOTHING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, base and added spans as arrays of (order, kind, start, end).

    Null counts as empty. Places are code points, ends exclusive. Base spans of a
    kind never overlap; an added span touches no base span and no better added
    one (of equal scores the first in order of kind, start and end). Rows may
    repeat; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = base_spans(rows)
    if selector == NOTHING:
        return rows.select("doc_id", "text", *[f"base_{k}" for k in KINDS], "base", F.expr("filter(base, b -> false)").alias("added"))
    rows = candidates(rows)
    scored = f"transform(filter(candidates, c -> NOT c.taken), c -> named_struct('score', -({selector.score}), 'order', c.order, 'start', c.start, 'end', c.end, 'kind', c.name))"
    rows = rows.withColumn("_scored", F.expr(f"filter({scored}, s -> s.score <= {-selector.threshold!r}D)"))
    # Candidates of one kind lie in order and never overlap: those that meet a candidate are neighbours, and over
    # all candidates of a text they are fewer than the candidates of both kinds.
    # Bound by a lambda, since a column of its own may be planned into the filter and made again for every candidate.
    of_kind = ", ".join(f"filter(_scored, s -> s.kind = '{k}')" for k in KINDS)
    beaten = f"exists(x.of, a -> exists(transform(array(struct({_leading('a', 'e.end <= s.start')} AS lo, {_leading('a', 'e.start < s.end')} AS hi)), r -> slice(a, r.lo + 1, greatest(r.hi - r.lo, 0)))[0], t -> t < s))"
    clear = f"transform(array(struct(_scored AS every, array({of_kind}) AS of)), x -> array_sort(filter(x.every, s -> NOT {beaten})))[0]"
    added = F.expr(f"transform({clear}, s -> named_struct('order', s.order, 'kind', s.kind, 'start', s.start, 'end', s.end))")
    return rows.select("doc_id", "text", *[f"base_{k}" for k in KINDS], "base", added.alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, by kind and start, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["order"], s["start"], s["end"], s["kind"]))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; overlapping spans count as one."""
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    step = """aggregate(_s, named_struct('at', 0L, 'out', ''), (a, s) ->
        CASE WHEN s.end <= a.at THEN a
             ELSE named_struct('at', s.end, 'out', a.out || substr(text, int(a.at + 1), int(greatest(s.start - a.at, 0))) || CASE WHEN s.start >= a.at THEN '[' || s.kind || ']' ELSE '' END) END)"""
    return found.withColumn("_s", ordered).withColumn("_a", F.expr(step)).select("doc_id", F.expr("_a.out || substr(text, int(_a.at + 1))").alias("text"))
