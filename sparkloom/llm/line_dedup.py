"""Line dedup by a log-template tree, on DataFrame functions only.

A line falls through a tree of fixed depth: its token count, then its leading
tokens, where a token with a digit counts as a variable field. All lines of a
leaf, equal ones too, tell its other fields: a token is fixed if at least
``texts`` texts, and at least the share ``share`` of those of the leaf, have it
at its place, and any other is a variable field. What results is a template if
enough of it is fixed and enough texts have it. A line without such a template
counts by itself, if enough texts hold it (two, if it has ``LONG`` tokens); so
do lines of one or two tokens, which have no leaf. Of what recurs the first line
stays (smallest id, then place) and all others are dropped, so that what was
said once in many copies stays once.

Counts are of different texts, so exact copies of a whole document are not
taken for templates; those are the near-duplicate operator's work.

A line may stand in a third of all texts. Counts are summed before they are
shuffled, and the joins on a line's digest have tables on both sides, so that
Spark splits the partition of such a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_split, cut, let, stored, unused

FIELD = "<*>"
BROADCAST_ROWS = 200_000
#: Lines of fewer tokens are compared as they stand, without fields.
SHORT = 3
#: Lines of so many tokens recur from two texts on.
LONG = 20


def _generalised(line: Column) -> Column:
    """The line's tokens, those with a digit as variable fields."""
    tokens = blank_split(line)
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))).otherwise(tokens)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _lines(docs: DataFrame, depth: int, what: str) -> DataFrame:
    """All lines but blank ones: place, leaf, number of tokens ``len``, and their ``tokens`` or the digest ``t`` of them.

    Lines of one or two tokens have no leaf and count as they stand, digits
    included. All is made inside of one array per document and then taken
    apart: a filter on rows would be pushed below and split every line once
    more.
    """
    def told(tokens: Column, line: Column, at: Column) -> Column:
        leaf = F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth))
        short = F.size(tokens) < SHORT
        if what == "tokens":
            own = tokens
        else:
            own = _digest(F.when(short, F.array_join(blank_split(line), " ")).otherwise(F.array_join(tokens, " ")))
        told_of = F.struct(at.alias("at"), F.when(~short, leaf).alias("leaf"), F.size(tokens).alias("len"), own.alias(what))
        return F.when(F.size(tokens) >= (SHORT if what == "tokens" else 1), told_of)

    made = F.transform(F.split("text", "\n"), lambda line, at: let(_generalised(line), lambda ts: told(ts, line, at)))
    kept = F.filter(made, lambda x: x.isNotNull())
    return docs.select("doc_id", F.xxhash64("text").alias("tk"), F.explode(kept).alias("e")).select("doc_id", "tk", "e.*")


def dropped_lines(docs: DataFrame, texts: int = 3, depth: int = 3, fixed: float = 0.6, share: float = 0.2) -> DataFrame:
    """``(doc_id, tk, at)``: the lines that go, ``at`` counted from zero, ``tk`` telling texts of one id apart."""
    slim = stored(_lines(docs, depth, "t"))
    where = ["doc_id", "tk", "at"]
    kinds = stored(
        slim.groupBy("t", "tk").agg(F.min("leaf").alias("leaf"), F.min("len").alias("len"), F.min(F.struct("doc_id", "at")).alias("one"))
        .groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("leaf").alias("leaf"), F.min("len").alias("len"), F.min(F.struct("tk", "one")).alias("one"))
        .select("t", "n", "leaf", "len", F.col("one.one.doc_id").alias("i"), F.col("one.tk").alias("k"), F.col("one.one.at").alias("a"))
    )
    leaves = cut(
        kinds.where("leaf is not null").groupBy("leaf").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("forms"))
        .where((F.col("all") >= texts) & (F.col("forms") > 1)).select("leaf", "all")
    )
    if leaves.count() <= BROADCAST_ROWS:
        leaves = F.broadcast(leaves)
    asked = kinds.join(leaves, "leaf").select("i", "k", "a", "t", "n", "all")
    met = _lines(docs, depth, "tokens").join(leaves.select("leaf"), "leaf")
    met = met.join(asked, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tk") == F.col("k")) & (F.col("at") == F.col("a"))).dropDuplicates(["t"])
    placed = stored(met.select("t", "n", "all", "leaf", "len", F.posexplode("tokens").alias("p", "token")))
    common = (
        placed.where(F.col("token") != FIELD).groupBy("leaf", "p", "token").agg(F.sum("n").alias("c"), F.first("all").alias("all"))
        .where((F.col("c") >= texts) & (F.col("c") >= share * F.col("all"))).select("leaf", "p", "token", F.lit(True).alias("common"))
    )
    shown = F.when(F.col("common"), F.col("token")).otherwise(F.lit(FIELD))
    forms = stored(
        placed.join(stored(common), ["leaf", "p", "token"], "left").groupBy("t", "len").agg(F.array_sort(F.collect_list(F.struct("p", shown.alias("s")))).alias("es"))
        .withColumn("es", F.col("es.s")).where(F.size(F.filter("es", lambda s: s != FIELD)) >= fixed * F.col("len"))
        .select("t", _digest(F.concat_ws(" ", F.lit(FIELD), F.col("len").cast("string"), F.array_join("es", " "))).alias("form"))
    )
    again = (
        slim.select("t", "tk").join(forms, "t").select("form", "tk").distinct()
        .groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= texts).select("form")
    )
    by_form = forms.join(again, "form")
    own = kinds.where(F.col("n") >= F.when(F.col("len") >= LONG, F.least(F.lit(2), F.lit(texts))).otherwise(texts)).select("t")
    names = stored(own.join(by_form, "t", "full").select("t", F.coalesce("form", "t").alias("name")))
    hits = stored(slim.join(names, "t").select(*where, "name"))
    first = hits.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk", "at")).alias("f"))
    kept = first.select("name", "f.doc_id", "f.tk", "f.at")
    h, k = hits.alias("h"), kept.alias("k")
    on = (F.col("h.name") == F.col("k.name")) & F.col("h.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("h.tk") == F.col("k.tk")) & (F.col("h.at") == F.col("k.at"))
    return h.join(k, on, "left_anti").select(*where).distinct()


def dedup(docs: DataFrame, texts: int = 3, depth: int = 3, fixed: float = 0.6, share: float = 0.2) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and ``n_lines`` and ``n_dropped``.

    A null text stays null and has no lines; an empty one has one line, which
    stays, as blank lines do. Repeated rows and equal texts of other ids are
    one text to the counts; their lines are dropped alike unless the template's
    first line is one of theirs. Null ids come after all others. An empty table
    gives none; other columns pass through, and columns named like the two new
    ones are replaced.
    """
    i, tk, gone_at = unused(docs, "_id", "_tk", "_gone")
    gone = dropped_lines(docs, texts, depth, fixed, share)
    gone = gone.groupBy(F.col("doc_id").alias(i), F.col("tk").alias(tk)).agg(F.collect_set("at").alias(gone_at))
    # the same join at every size: what goes grows with the documents
    joined = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(tk)), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, at: ~F.array_contains(gone_at, at)), "\n")
    shown = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(left)
    return joined.select(
        *[shown.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias("n_dropped"),
    )
