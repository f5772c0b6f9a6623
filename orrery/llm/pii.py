"""Personal data: seed patterns and bootstrapped contextual extraction.

1. Seeds: e-mail addresses, IPv4 addresses, payment cards and phone numbers, found by regular expressions in whole texts.
2. Contexts: the two words before a seed form a lexical pattern; every other token that is shaped like an identifier (it
   holds a digit or an at sign) and stands behind the same two words is an instance of the pattern.  Words are runs of
   letters, cut where a match of the same kind begins or ends, in lower case; they are looked for in the whole text before
   the match, other matches included, and only white space, commas, colons, semicolons and opening brackets may stand
   between the second word and the match.
3. The graph of patterns and instances is scored in rounds: a pattern's confidence for a kind is the mean confidence of its
   instances, an unseen instance's confidence is 1 - product(1 - confidence) over its patterns; seeds have confidence 1.
4. Patterns induced by enough different seeds and confident enough give their unseen instances as further spans.

Everything runs on DataFrame functions.  Texts are read once; what goes on are lengths, matches and contexts of the
matches.  Patterns are aggregated before each shuffle, so a pattern that a third of all tokens follow is one row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import Scratch, table, whole_text

KINDS = ("email", "ip", "card", "phone")

# Each expression finds the same matches as its plain form, in linear time: a match can begin only where the run of
# characters that it opens with begins, or where the match before has ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these has no match.
_NEEDS = {"email": "contains(text, '@')", "ip": "contains(text, '.')", "card": "true", "phone": "contains(text, '+')"}
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: On a reversed text: what follows its last word, the last word, and the one before.
_LAST = r"^([^\p{L}]*+)(?:(\p{L}++)(?:[^\p{L}]++(\p{L}++))?)?"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
def _q(regex: str) -> str:
    return "r'" + regex.replace("'", "\\'") + "'"


def _last(text: str, group: int) -> str:
    return f"nullif(lower(reverse(regexp_extract(reverse({text}), {_q(_LAST)}, {group}))), '')"


def _near(text: str) -> str:
    """Whether only white space and the like follow the last word."""
    return f"regexp_extract(reverse({text}), {_q(_LAST)}, 1) RLIKE {_q('^[ ' + chr(92) + 't-' + chr(92) + 'r,:;(]*$')}"


def _found(kind: str, regex: str, need: str) -> Column:
    """The matches, each with the code points between it and the match before, and the last two words there."""
    gaps = f"split(text, {_q(regex)}, -1)"
    return F.expr(f"""CASE WHEN {need} THEN zip_with(regexp_extract_all(text, {_q(regex)}, 0), {gaps}, (m, g) -> IF(m IS NULL, NULL, named_struct(
        'match', m, 'gap', char_length(g), 'first', {_last('g', 3)}, 'second', {_last('g', 2)}, 'near', {_near('g')}))) END""").alias(kind)


def _valid() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    luhn = F.expr("""aggregate(transform(split(reverse(regexp_replace(match, '[^0-9]', '')), ''), (c, i) -> IF(i % 2 = 0, CAST(c AS INT),
        IF(CAST(c AS INT) > 4, CAST(c AS INT) * 2 - 9, CAST(c AS INT) * 2))), 0, (a, x) -> a + x) % 10 = 0""")
    return (F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", F.col("match").rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"))
            .when(F.col("kind") == "card", F.when(n.between(12, 19), luhn).otherwise(False)).when(F.col("kind") == "phone", n.between(9, 15)).otherwise(True))


def scan(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, matches): one row for each row, matches as an array of (kind, match, gap, first, second, near, pos)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.select("doc_id", *[_found(k, PATTERNS[k], _NEEDS[k]) for k in KINDS], _found("token", _TOKEN, "true"))
    both = F.concat(*[F.expr(f"""transform(filter(coalesce({k}, array()), x -> x IS NOT NULL), (x, i) -> named_struct(
        'kind', '{k}', 'match', x.match, 'gap', x.gap, 'first', x.first, 'second', x.second, 'near', x.near, 'pos', i))""") for k in (*KINDS, "token")])
    return scratch.save(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", both.alias("matches")), "matches")


def _contexts(rows: DataFrame, w: WindowSpec) -> DataFrame:
    """With ``context``: where the gap before a match has fewer than two words, those of earlier gaps and matches count."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own_first, own_second = F.expr(_last("match", 3)), F.expr(_last("match", 2))
    rows = rows.withColumns({"own_first": own_first, "own_second": own_second}).withColumn("last", F.coalesce("own_second", "second"))
    rows = rows.withColumn("before", F.last("last", ignorenulls=True).over(before))
    # the last but one after this match: of the match, of its gap, or of what was before
    rows = rows.withColumn("last_but_one", F.when(F.col("own_second").isNotNull(), F.coalesce("own_first", "second", "before")).otherwise(F.coalesce("first", "before")))
    rows = rows.withColumn("before_that", F.last(F.when(F.col("last").isNotNull(), F.struct("last_but_one")), ignorenulls=True).over(before)["last_but_one"])
    touches = F.coalesce(F.lag(F.col("match").rlike(r"\p{L}$")).over(w), F.lit(False))
    one = F.when(F.col("second").isNotNull(), F.coalesce("first", "before")).when(touches, F.col("before_that"))
    two = F.when(F.col("second").isNotNull(), F.col("second")).when(touches, F.col("before"))
    context = F.when(F.col("near") & one.isNotNull() & two.isNotNull(), F.concat_ws(" ", one, two)).otherwise("")
    return rows.withColumn("context", context).drop("own_first", "own_second", "first", "second", "near", "last", "before", "last_but_one", "before_that")


def spans(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, kind, start, end, context, surface): valid base spans, and as kind ``token`` the shaped tokens that touch none."""
    rows = found.select("uid", F.explode("matches").alias("m")).select("uid", "m.*")
    w = Window.partitionBy("uid", "kind").orderBy("pos")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("match")).over(w)).withColumn("start", F.col("end") - F.char_length("match"))
    rows = _contexts(rows, w)
    rows = rows.filter(_valid())
    # a token without the punctuation around it
    left = F.ltrim(F.col("match"), F.lit("([{<\"'"))
    core = F.rtrim(left, F.lit(")]}>\"'.,;:!?"))
    token = F.col("kind") == "token"
    rows = rows.withColumns({"start": F.when(token, F.col("end") - F.char_length(left)).otherwise(F.col("start")),
                             "end": F.when(token, F.col("end") - F.char_length(left) + F.char_length(core)).otherwise(F.col("end")),
                             "surface": F.lower(F.when(token, core).otherwise(F.col("match")))})
    base_end, base_start = F.when(~token, F.col("end")), F.when(~token, F.col("start"))
    ahead = Window.partitionBy("uid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("uid").orderBy(F.desc("start"), "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last_end", F.max(base_end).over(ahead)).withColumn("next_start", F.min(base_start).over(behind))
    free = (F.coalesce("last_end", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next_start") >= F.col("end"), F.lit(True))
    return scratch.save(rows.filter(~token | free & (F.col("start") < F.col("end"))).select("uid", "kind", "start", "end", "context", "surface"), "spans")


def confident(rows: DataFrame, scratch: Scratch, min_seeds: int = 5, min_confidence: float = 0.9, rounds: int = 3) -> DataFrame:
    """(context, surface, found): unseen instances, by pattern, and the kind that they are taken for."""
    graph = rows.filter("context LIKE '_% _%'").groupBy("context", "surface", "kind").agg(F.count("*").alias("n"))
    seeds = graph.filter("kind <> 'token'").groupBy("context", F.col("kind").alias("found")).agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= min_seeds)
    seeds = scratch.save(seeds, "seeds")
    graph = scratch.save(graph.join(seeds.select("context").distinct(), "context"), "graph")
    belief = None
    for i in range(rounds):
        edges = graph.join(seeds, "context")  # a row for each kind that the pattern may stand for, four at most
        if belief is None:
            edges = edges.withColumn("belief", F.lit(0.0))
        else:
            edges = edges.join(belief, ["surface", "found"], "left")
        sure = F.when(F.col("kind") == F.col("found"), 1.0).when(F.col("kind") == "token", F.coalesce("belief", F.lit(0.0))).otherwise(0.0)
        patterns = edges.groupBy("context", "found").agg((F.sum(sure * F.col("n")) / F.sum("n")).alias("confidence"))
        patterns = scratch.save(patterns, f"patterns{i}")
        of = graph.filter("kind = 'token'").join(patterns, "context")
        belief = scratch.save(of.groupBy("surface", "found").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999999)))))).alias("belief")), f"belief{i}")
    good = patterns.filter(F.col("confidence") >= min_confidence)
    best = belief.groupBy("surface").agg(F.max_by("found", F.struct("belief", "found")).alias("found"))
    return graph.filter("kind = 'token'").join(good, "context").join(best, ["surface", "found"]).select("context", "surface", "found")


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **method) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id) for every row, and (uid, kind, start, end, base) for every span, base ones and discovered ones.

    Offsets are code points, ends are exclusive.  A null text counts as an empty one and has no span; rows that repeat
    are kept apart by uid; other columns are ignored.
    """
    scratch = scratch or Scratch(spark, "pii")
    found = scan(docs, scratch, id_col, text_col)
    rows = spans(found, scratch)
    more = rows.filter("kind = 'token'").join(confident(rows, scratch, **method), ["context", "surface"]).select(
        "uid", F.col("found").alias("kind"), "start", "end", F.lit(False).alias("base"))
    base = rows.filter("kind <> 'token'").select("uid", "kind", "start", "end", F.lit(True).alias("base"))
    return found.select("uid", "doc_id"), base.unionByName(more)


def _rank() -> Column:
    return reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS, F.when(F.lit(False), -1)).otherwise(len(KINDS))


def report(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """For each row: doc_id, counts of base spans by kind, the digest of the base spans, and all spans as kind:start:end."""
    rows, all_spans = find(spark, docs, **options)
    text = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    item = F.struct("start", _rank().alias("rank"), "end", "kind", "base")
    per = all_spans.groupBy("uid").agg(F.array_sort(F.collect_list(item)).alias("s"), *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS])
    per = per.select("uid", *[f"n_{k}" for k in KINDS], F.expr(text.format("filter(s, x -> x.base)")).alias("base_spans"), F.expr(text.format("s")).alias("spans"))
    none = F.lit("")
    return rows.join(per, "uid", "left").select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                                                F.sha2(F.coalesce("base_spans", none).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **method) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets, [EMAIL] and so on; all columns stay.

    Spans that overlap are replaced as one, by the kind of the first.  Texts without a span, null ones too, stay as they
    are; ``n_chars``, where there is one, follows a text that changes.
    """
    scratch = Scratch(spark, "redact")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    text = at[text_col]
    marked = docs.toDF(*names).withColumn("_key", F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    # spans depend on the text alone, so equal texts need one set of them
    rows, all_spans = find(spark, marked.select(F.col("_key").alias("doc_id"), F.col(text).alias("text")), scratch=scratch, **method)
    s = all_spans.join(rows.select("uid", F.col("doc_id").alias("_key")), "uid").select("_key", "kind", "start", "end").distinct()
    w = Window.partitionBy("_key").orderBy("start", F.desc("end"), _rank())
    s = s.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("block", F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(w))
    merged = s.groupBy("_key", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), _rank())).alias("kind"))
    per = scratch.save(merged.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.upper("kind").alias("kind")))).alias("_s")), "per")
    scratch.drop("matches", "spans")
    new = F.expr(f"""IF(_s IS NULL, {text}, concat(array_join(transform(_s, (x, i) -> concat(substring({text}, CAST(IF(i = 0, 0, _s[i - 1].end) AS INT) + 1,
        CAST(x.start - IF(i = 0, 0, _s[i - 1].end) AS INT)), '[', x.kind, ']')), ''), substring({text}, CAST(_s[size(_s) - 1].end AS INT) + 1)))""")
    out = marked.join(per, "_key", "left").withColumn("_new", new)
    return out.select(*[F.col("_new").alias(c) if c == text_col else F.when(F.col("_s").isNull(), F.col(at[c])).otherwise(F.char_length("_new").cast("long")).alias(c) if c == "n_chars" else F.col(at[c]).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, table(spark, sf_dir, "documents"))
