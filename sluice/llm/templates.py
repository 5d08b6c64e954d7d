"""Line dedup by a log-template tree, in DataFrame code.

A line goes down a tree of fixed depth: first by its number of tokens, then by its
leading tokens. Tokens with digits are variable fields from the start. In a leaf, a
position is a variable field too if enough different lines are equal but for it;
so a field is what the template's own lines show to vary, and two lines that differ
in a word stay different. Lines of templates that recur across documents are
dropped everywhere but in the first document. All steps are sums over keys, so a
frequent leaf, template or line is nobody's single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import cut, stage

FIELD = "<*>"
#: Leading tokens below the node of a token count, and the share of a line's tokens that are no fields found by counting.
DEPTH, SIMILARITY = 3, 0.8
#: A position is a field if so many different lines of a leaf are equal everywhere else.
FIELD_VALUES = 10
#: Lines of fewer tokens are never dropped.
MIN_TOKENS = 3
#: A table of so many rows is small enough to broadcast; it is counted first.
BROADCAST_ROWS = 500_000


def masked(line: Column) -> Column:
    """Tokens of a line, joined by single spaces, those with a digit as a field. Most lines need neither replacement."""
    plain = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", FIELD)).otherwise(line)
    return F.trim(F.when(plain.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")).otherwise(plain))


def masked_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda s: masked(s))


def _tokens(line: Column) -> Column:
    """The number of tokens of a masked line that is not blank."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _leaf(line: Column, depth: int) -> Column:
    return F.xxhash64(_tokens(line), F.substring_index(line, " ", depth))


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lines_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Rows (``doc``, ``print``, ``lines``): a text's hash, and for each of its lines hashes (``line``, ``leaf``), null for lines too short to drop."""
    one = lambda s: F.when((s != "") & (_tokens(s) >= min_tokens), F.struct(F.xxhash64(s).alias("line"), _leaf(s, depth).alias("leaf")))
    text = F.col(text_col)
    return docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("print"), F.transform(masked_lines(text), one).alias("lines"))


def _fields(lines: DataFrame, leaves: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, depth: int, similarity: float, values: int) -> DataFrame:
    """Rows (``line``, ``template``, ``pattern``): the lines of ``leaves`` that have fields found by counting, and their template."""
    some = lines.select("doc", "print", F.posexplode("lines").alias("at", "l")).where("l is not null").select("doc", "print", "at", "l.line", "l.leaf").join(_small(leaves), "leaf", "left_semi")
    # The words of a line are read from one text that holds it.
    held = some.groupBy("line", "leaf").agg(F.min(F.struct("doc", "print", "at")).alias("in")).groupBy("in.doc", "in.print").agg(F.collect_list(F.struct("line", "leaf", "in.at")).alias("l"))
    held = _small(cut(held.withColumnsRenamed({"doc": "__doc", "print": "__print"})))
    texts = docs.join(held, (docs[id_col] == F.col("__doc")) & (F.xxhash64(docs[text_col]) == F.col("__print"))).select(F.split(docs[text_col], "\n").alias("own"), F.explode("l").alias("l"))
    texts = texts.select("l.line", "l.leaf", masked(F.get("own", F.col("l.at"))).alias("text")).dropDuplicates(["line", "leaf"])
    # A line is the exclusive or of its tokens' hashes, so that a line without one of them is one step away.
    hashed = texts.select("leaf", "line", F.split("text", " ").alias("t")).withColumn("h", F.transform("t", lambda w, i: F.xxhash64(i, w)))
    hashed = hashed.withColumn("sum", F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    whole = cut(hashed.select("leaf", "line", "t", "h", "sum"))
    holes = whole.select("leaf", "line", F.posexplode("h").alias("at", "x"), "t", "sum").where((F.col("at") >= depth) & (F.get("t", F.col("at")) != FIELD))
    holes = holes.select("line", "at", F.xxhash64("leaf", "at", F.col("sum").bitwiseXOR(F.col("x"))).alias("hole"))
    variable = cut(holes.groupBy("hole").count().where(F.col("count") >= values).select("hole"))
    places = holes.join(_small(variable), "hole", "left_semi").groupBy("line").agg(F.array_sort(F.collect_list("at")).alias("places"))
    found = whole.join(places, "line").where(F.size("places") <= F.floor(F.size("t") * F.lit(1 - similarity) + F.lit(1e-9)))
    changed = F.aggregate("places", F.col("sum"), lambda a, i: a.bitwiseXOR(F.get("h", i)).bitwiseXOR(F.xxhash64(i, F.lit(FIELD))))
    pattern = F.array_join(F.transform("t", lambda w, i: F.when(F.array_contains("places", i), F.lit(FIELD)).otherwise(w)), " ")
    return found.select("line", F.xxhash64("leaf", changed).alias("template"), pattern.alias("pattern"))


def recurring(lines: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, values: int = FIELD_VALUES) -> DataFrame:
    """Rows (``line``, ``first_doc``): hashes of the masked lines whose template is in two documents or more, and the first of these."""
    each = lines.select("doc", F.explode("lines").alias("l")).where("l is not null").select("doc", "l.line", "l.leaf")
    each = cut(each.groupBy("line", "leaf").agg(F.min("doc").alias("low"), F.max("doc").alias("high")))
    leaves = cut(each.groupBy("leaf").count().where(F.col("count") >= values).select("leaf"))
    fields = cut(_fields(lines, leaves, docs, id_col=id_col, text_col=text_col, depth=depth, similarity=similarity, values=values).select("line", "template"))
    general = each.join(_small(fields), "line")
    shared = general.groupBy("template").agg(F.min("low").alias("first_doc"), F.max("high").alias("last")).where("first_doc <> last").select("template", "first_doc")
    exact = each.where("low <> high").join(_small(fields.select("line")), "line", "left_anti").select("line", F.col("low").alias("first_doc"))
    return exact.unionByName(general.join(shared, "template").select("line", "first_doc"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, **more) -> DataFrame:
    """``docs`` without lines of recurring templates, which only the document of smallest id keeps.

    All rows and columns stay; a text may become empty. Null texts stay null.
    Rows with a null id lose nothing and make nothing recur; rows of one id count
    as one document. Lines of fewer than ``min_tokens`` tokens, blank ones too,
    stay. ``count_col`` names a column to add with the number of dropped lines.
    """
    lines, _ = stage(lines_of(docs, id_col=id_col, text_col=text_col, depth=depth, min_tokens=min_tokens), "lines")
    known = cut(recurring(lines, docs, id_col=id_col, text_col=text_col, depth=depth, **more))
    at = lines.select("doc", "print", F.posexplode("lines").alias("at", "l")).where("l is not null").select("doc", "print", "at", "l.line")
    hit = at.join(_small(known), "line").where(F.col("doc") != F.col("first_doc"))
    lost = hit.groupBy(F.col("doc").alias("__lost_doc"), F.col("print").alias("__lost_print")).agg(F.collect_set("at").alias("__lost"))
    own = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__lost"))
    kept = F.when(F.col("__lost").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n"))
    joined = docs.join(lost, (docs[id_col] == F.col("__lost_doc")) & (F.xxhash64(docs[text_col]) == F.col("__lost_print")), "left")
    columns = [kept.alias(c) if c == text_col else docs[c] for c in docs.columns]
    if count_col is not None:
        columns.append(F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long").alias(count_col))
    return joined.select(*columns)
