"""Line deduplication by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line goes by its number of tokens, then by its leading
tokens, to a leaf. Digits are masked beforehand, as fields that vary. A leaf has a list of
templates. The first is led by the leaf's most frequent line: lines that agree with it in
enough places are of it, whose other places are variable fields. Among the leaf's other
lines, words met at a place too seldom to recur are variable fields; lines that are the
same but for these, in as many places, are of one template, and every other line is a
template of its own. (Leading by one line after another would take a round for each
template of a leaf; this takes one for all.) A template that recurs across documents stays
in the first of them and is dropped elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import checkpoint_folder, cut, forget, unused

LEADING, AGREE, LEAST_TOKENS, LEAST_DOCS = 3, 0.8, 4, 3
_LINE, _TEMPLATE = ["line", "line2"], ["template", "template2"]


def _tokens(line):
    return F.array_remove(F.split(F.regexp_replace(line, "[0-9]+", "#"), r"\s+"), "")


def _two(*parts) -> tuple:
    """Two hashes of 64 bits, by both of which lines and templates are told apart."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)


def _keyed(docs: DataFrame) -> DataFrame:
    """(k, doc, text): doc tells documents apart (by id, without one by text); with it, k is the key of a row's text."""
    one = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text"))
    return one.select(_key("doc", "text").alias("k"), F.coalesce("doc", _key("doc", "text")).alias("doc"), "text")


def _key(doc_id, text):
    return F.xxhash64(doc_id, text)


def _lines(keyed: DataFrame, leading: int, least_tokens: int) -> DataFrame:
    """(k, doc, pos, leaf, line, line2): each line of each document, by hashes."""
    each = keyed.select("k", "doc", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    each = each.select("k", "doc", "pos", _tokens("raw").alias("t")).where(F.size("t") >= least_tokens)
    line, line2 = _two("t")
    return each.select("k", "doc", "pos", F.xxhash64(F.size("t"), F.slice("t", 1, leading)).alias("leaf"), line.alias("line"), line2.alias("line2"))


def _candidates(keyed: DataFrame, leading: int, least_tokens: int, least_docs: int) -> DataFrame:
    """The lines of leaves that hold least_docs lines at least; no template of another leaf can recur. Written once, by columns."""
    spark, folder = keyed.sparkSession, checkpoint_folder(keyed.sparkSession)
    _lines(keyed, leading, least_tokens).write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    # Cut, as below: an aggregate that is its own shuffle's end leaves AQE no way to split a frequent key of the join.
    full = cut(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("leaf"))
    lines.join(full, "leaf", "left_semi").write.parquet(f"{folder}/candidates")
    forget(spark, f"{folder}/lines")
    return spark.read.parquet(f"{folder}/candidates")


def _variants(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """(leaf, line, line2, n, leads, t) of leaves with several lines: each line once, how often it is there, whether it leads, and its tokens."""
    distinct = cut(lines.groupBy("leaf", *_LINE).agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos", "k")).alias("at")))
    led = distinct.groupBy("leaf").agg(F.count("*").alias("m"), F.min(F.struct(-F.col("n"), "at", *_LINE)).alias("lead"))
    led = cut(led.where(F.col("m") > 1).select("leaf", F.col("lead.line").alias("l"), F.col("lead.line2").alias("l2")))
    leads = (F.col("line") == F.col("l")) & (F.col("line2") == F.col("l2"))
    one = F.struct(F.col("at.pos").alias("pos"), "leaf", *_LINE, "n", leads.alias("leads"))
    wanted = distinct.join(led, "leaf").groupBy(F.col("at.k").alias("k"), F.col("at.doc").alias("doc")).agg(F.collect_list(one).alias("of"))
    found = wanted.join(keyed, ["k", "doc"]).select(F.split("text", "\n").alias("all"), F.explode("of").alias("of"))
    return cut(found.select("of.leaf", "of.line", "of.line2", "of.n", "of.leads", _tokens(F.get("all", "of.pos")).alias("t")).dropDuplicates(_LINE))


def _maskable(rest: DataFrame, leading: int, agree: float, least_docs: int) -> DataFrame:
    """Those of rest (leaf, line, line2, n, t) that can be of a template with fields that recurs; a template of another line can't.

    No word of a line that is there least_docs times is seldom. Lines of one template have
    their fields at the same places, at most the share 1 - agree of all. So of one more
    blocks of places than that, one is without a field and the same in all these lines:
    what has no block in common with others, together least_docs times, is left out. The
    blocks' rows are a fraction of the words', of which most are met in no other line.
    """
    size = F.size("t")
    most = (size - F.ceil(F.lit(agree) * size)).cast("int")
    few = rest.where(F.col("n") < least_docs).withColumn("most", most).where("most > 0")
    start = lambda i: leading + F.floor(i * F.greatest(size - leading, F.lit(0)) / (F.col("most") + 1)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), "most"), lambda i: F.xxhash64("leaf", i, F.slice("t", start(i) + 1, start(i + 1) - start(i))))
    blocks = few.select(*_LINE, "n", F.explode(hashed).alias("block"))
    shared = cut(blocks.groupBy("block").agg(F.sum("n").alias("c")).where(F.col("c") >= least_docs).select("block"))
    found = blocks.join(shared, "block", "left_semi").select(*_LINE).distinct()
    return rest.join(found, _LINE, "left_semi")


def _templates(variants: DataFrame, leading: int, agree: float, least_docs: int) -> DataFrame:
    """(line, line2, template, template2) for lines whose template is not they themselves."""
    heads = variants.where("leads").select("leaf", F.col("t").alias("lt"), *[F.col(a).alias(b) for a, b in zip(_LINE, _TEMPLATE)])
    alike = F.size(F.filter(F.zip_with("t", "lt", lambda a, b: a == b), lambda x: x)) >= F.lit(agree) * F.size("t")
    judged = cut(variants.where("not leads").join(heads, "leaf").select("leaf", *_LINE, "n", "t", *_TEMPLATE, F.coalesce(alike, F.lit(False)).alias("alike")))
    rest = judged.where("not alike").select("leaf", *_LINE, "n", "t")
    maskable = cut(_maskable(rest, leading, agree, least_docs))
    near = rest.join(maskable.select("leaf").distinct(), "leaf", "left_semi")
    words = near.select("leaf", F.posexplode("t").alias("pos", "word"), "n").where(F.col("pos") >= leading)
    seldom = cut(words.groupBy("leaf", "pos", "word").agg(F.sum("n").alias("c")).where(F.col("c") < least_docs).select("leaf", "pos", "word"))
    mine = maskable.select("leaf", *_LINE, F.posexplode("t").alias("pos", "word")).where(F.col("pos") >= leading)
    fields = mine.join(seldom, ["leaf", "pos", "word"]).groupBy(*_LINE).agg(F.collect_list("pos").alias("fields"))
    # No token is empty, so an empty one can stand for a field.
    shape = F.transform("t", lambda x, i: F.when(F.array_contains("fields", i), F.lit("")).otherwise(x))
    masked = maskable.join(fields, _LINE).where(F.size("t") - F.size("fields") >= F.lit(agree) * F.size("t")).select(*_LINE, shape.alias("shape"))
    # Cut, as it is read for the templates that recur and again for their lines.
    return cut(judged.where("alike").select(*_LINE, *_TEMPLATE).union(masked.select(*_LINE, *[h.alias(c) for h, c in zip(_two("shape"), _TEMPLATE)])))


def recurring(keyed: DataFrame, leading: int = LEADING, agree: float = AGREE, least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(k, doc, drop array<int>): by document, the places of lines whose template recurs and stays elsewhere."""
    lines = _candidates(keyed, leading, least_tokens, least_docs)
    templates = _templates(_variants(keyed, lines), leading, agree, least_docs)
    placed = lines.join(templates, _LINE, "left").select("k", "doc", "pos", *[F.coalesce(t, c).alias(t) for t, c in zip(_TEMPLATE, _LINE)])
    spread = placed.select(*_TEMPLATE, "doc").distinct().groupBy(*_TEMPLATE).agg(F.count("*").alias("docs"), F.min("doc").alias("first")).where(F.col("docs") >= least_docs)
    gone = placed.join(cut(spread), _TEMPLATE).where("doc <> first").select("k", "doc", "pos").distinct()
    return gone.groupBy("k", "doc").agg(F.collect_list("pos").alias("drop"))


def dedup(docs: DataFrame, **kinds) -> DataFrame:
    """docs with text without its dropped lines, and n_lines, n_dropped.

    Lines end at line feeds. Tokens are parted by white space; runs of digits count as one
    sign. Lines of fewer than least_tokens tokens are never dropped. A template recurs if
    it is in least_docs documents at least (told apart by doc_id; documents without an id
    by their text); it stays in the one with the smallest doc_id, however often it is
    there. A line is of its leaf's leading template if at least the share `agree` of its
    tokens equal the leader's at the same places. The leader is the leaf's most frequent
    line, of several the one met first (doc_id, place). Of the other lines, a token beyond
    the leading ones that is met fewer than least_docs times at its place among them is a
    field, and lines with the same fields and otherwise the same tokens are of a template;
    but a line of which more than the share 1 - `agree` is fields has its own.

    Null texts stay null (no lines); an empty text is one empty line. Repeated rows with
    one doc_id and text count as one document and each return. Other columns pass through,
    whatever their names; columns named n_lines or n_dropped are replaced. Every row of
    docs returns, also one that has lost every line. Frequent lines are counted before they
    are shuffled, and every join is an equi-join whose frequent keys AQE can split. Lines
    and templates are told apart by 128 bits.
    """
    plain = docs.drop("n_lines", "n_dropped")
    k, doc, drop, lines = unused(plain, "k", "doc", "drop", "lines")
    gone = recurring(_keyed(plain), **kinds).toDF(k, doc, drop)
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    met = plain.withColumn(k, _key(doc_id, text)).withColumn(doc, F.coalesce(doc_id, F.col(k))).join(gone, [k, doc], "left")
    met = met.withColumn(lines, F.split(text, "\n"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n")
    out = F.when(F.col(drop).isNull(), text).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    n_dropped = F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("bigint")
    return met.select(*[out.alias("text") if c == "text" else F.col(c) for c in plain.columns], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
