"""Line dedup by content-defined line chunks [native].

Texts are split at ``\\n``. Each line has a hash; a polynomial rolling hash over the hashes of the
last ``WINDOW`` lines marks a possible cut after a line, and a cut is made where a mark does not
follow another mark. Cuts depend on the nearby lines alone, so the same passage is cut alike wherever
it stands and inserted lines move no later cut. Chunks then hold two lines or more, except at the
ends of a text. Of each chunk of ``min_lines`` lines or more (with a word in it) that occurs more than once in
all texts, the first occurrence (smallest id, then earliest place) stays and the others are removed.

Cuts enclose a passage of a few lines only by chance, so each chunk edge is followed up exactly: every window of ``min_lines``
lines (with a word in it), across cuts or not, is counted like a chunk, and its lines are removed where its bytes stand before it
(smaller id, or earlier in its text without overlap). Thus every repeated run of ``min_lines`` lines is found, and every removed line
stays in an earlier place.

The shuffles stay narrow: pieces (chunks and windows) are counted by hash without their bytes; only pieces whose hash repeats are cut
out of the texts again and compared by their bytes. Tables that grow with the documents are joined by shuffles at every size, never by
a broadcast.

Defined cases: a null text stays null and has no chunk; an empty text has no chunk with a word; rows
that repeat an id are one document per different text (equal rows keep or lose the same lines, and
the first row of an id counts as first occurrence); a null id orders before all others; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

WINDOW, BASE = 3, 31
RESULTS = ("n_lines", "n_removed_lines", "n_removed_chunks", "dedup_text")
PASSAGE_RESULTS = ("n_lines", "n_removed_lines", "n_removed_passages", "dedup_text")
WORD = r"[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks(text: Column, mean_lines: int = 4, with_start: bool = False) -> Column:
    """Array of chunks of a text, each an array of lines (``with_start``: and the number of lines before it)."""
    def rolled(h, i):
        at = lambda d: F.when(i > d, F.element_at(h, F.greatest(i - d, F.lit(1)))).otherwise(F.lit(0))
        return at(0) + at(1) * BASE + at(2) * BASE * BASE

    def cuts(h):
        mark = lambda i: F.pmod(rolled(h, i), F.lit(mean_lines)) == 0
        inner = F.filter(F.sequence(F.lit(1), F.size(h)),
                         lambda i: (i > 1) & (i < F.size(h)) & mark(i) & ~((i > 2) & mark(i - 1)))
        return F.concat(inner, F.array(F.size(h)))

    def part(start, own):
        return F.struct(start.alias("at"), own.alias("lines")) if with_start else own

    def cut_up(lines):
        ends = lambda c: F.transform(
            c, lambda e, k: let(F.when(k > 0, F.element_at(c, F.greatest(k, F.lit(1)))).otherwise(0),
                                lambda s: part(s, F.slice(lines, s + 1, e - s))))
        return let(cuts_of(lines), ends)

    def cuts_of(lines):
        return let(F.transform(lines, line_hash), cuts)
    return let(F.split(text, "\n"), cut_up)


def windows(text: Column, min_lines: int) -> Column:
    """Array of (kind, lines before it, lines, bytes) of each run of ``min_lines`` lines of a text."""
    def of(lines):
        starts = F.when(F.size(lines) >= min_lines, F.sequence(F.lit(0), F.size(lines) - min_lines)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            F.lit(1).alias("kind"), i.alias("at"), F.lit(min_lines).alias("k"),
            F.array_join(F.slice(lines, i + 1, min_lines), "\n").alias("body")))
    return let(F.split(text, "\n"), of)


def whole_chunks(text: Column, mean_lines: int, min_lines: int) -> Column:
    """Like ``windows``, of the chunks of ``min_lines`` lines or more."""
    enough = F.filter(chunks(text, mean_lines, True), lambda c: F.size(c["lines"]) >= min_lines)
    return F.transform(enough, lambda c: F.struct(
        F.lit(0).alias("kind"), c["at"].alias("at"), F.size(c["lines"]).alias("k"), F.array_join(c["lines"], "\n").alias("body")))


def _removed(df: DataFrame, doc_id: str, text: str, mean_lines: int, min_lines: int, results: tuple[str, ...]) -> DataFrame:
    keep = [c for c in df.columns if c not in results]
    base = df.select(*keep)
    found = F.concat(whole_chunks(F.col(text), mean_lines, min_lines), windows(F.col(text), min_lines))
    parts = base.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.inline(found)).where(F.col("body").rlike(WORD))
    parts = written(parts.select("id", "th", "kind", "at", "k", F.xxhash64("kind", "body").alias("h")), "line-parts")
    hashes = written(parts.groupBy("h").count().where("count > 1").select("h"), "line-hashes")
    hits = parts.join(hashes.hint("merge"), "h").groupBy("id", "th").agg(
        F.collect_set(F.struct("kind", "at", "k", "h")).alias("__hits")).withColumnsRenamed({"id": "__id", "th": "__th"})
    same_text = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th"))
    texts = base.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("__key"), F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("__h"))
    bodies = let(F.split("__text", "\n"), lambda lines: F.transform("__hits", lambda p: F.struct(
        p["kind"].alias("kind"), p["at"].alias("at"), p["k"].alias("k"), p["h"].alias("h"),
        F.array_join(F.slice(lines, p["at"] + 1, p["k"]), "\n").alias("body"))))
    again = written(texts.join(written(hits, "line-hits").hint("merge"), same_text).select(
        F.col("__id").alias("id"), F.col("__th").alias("th"), F.inline(bodies)), "line-bodies")
    first = written(again.groupBy("h", "kind", "body").agg(F.min(F.struct("id", "th", "at")).alias("first"),
                                                           F.count(F.lit(1)).alias("n")).where("n > 1"), "line-first")
    own = F.col("a.id").eqNullSafe(F.col("first.id")) & (F.col("a.th") == F.col("first.th"))
    later = (again.alias("a").join(first.hint("merge").alias("f"), (F.col("a.h") == F.col("f.h"))
                                   & (F.col("a.kind") == F.col("f.kind")) & (F.col("a.body") == F.col("f.body")))
             .where(~(own & (F.col("a.at") < F.col("first.at") + F.col("a.k")))))
    spans = later.groupBy("a.id", "a.th").agg(F.collect_set(F.struct("a.kind", "a.at", "a.k")).alias("spans"))
    numbers = F.array_distinct(F.flatten(F.transform("spans", lambda p: F.sequence(p["at"], p["at"] + p["k"] - 1))))
    gone = written(spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), numbers.alias("__gone"),
                                F.size(F.filter("spans", lambda p: p["kind"] == 0)).alias("__chunks")), "line-gone")
    marked = base.withColumn("__h", F.xxhash64(F.col(text))).join(
        gone.hint("merge"), F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    none, lines = F.col("__gone").isNull(), F.split(F.col(text), "\n")
    left = let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")),
                                            lambda i: F.element_at(x, i + 1)))
    runs = F.size(F.array_except("__gone", F.transform("__gone", lambda i: i + 1)))
    made = {"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "n_removed_lines": F.when(none, 0).otherwise(F.size("__gone")).cast("long"),
            "n_removed_chunks": F.when(none, 0).otherwise(F.col("__chunks")).cast("long"),
            "n_removed_passages": F.when(none, 0).otherwise(runs).cast("long"),
            "dedup_text": F.when(none, F.col(text)).otherwise(F.array_join(left, "\n"))}
    return marked.select(*keep, *[made[c].alias(c) for c in results])


def remove_repeated_chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           mean_lines: int = 4, min_lines: int = 2) -> DataFrame:
    """All columns of ``df`` plus ``RESULTS``; ``dedup_text`` is the text without its repeated lines, ``n_removed_chunks``
    counts the removed content-defined chunks."""
    return _removed(df, doc_id, text, mean_lines, min_lines, RESULTS)


def remove_repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                             mean_lines: int = 4, min_lines: int = 2) -> DataFrame:
    """Like ``remove_repeated_chunks``; ``n_removed_passages`` counts the runs of removed lines."""
    return _removed(df, doc_id, text, mean_lines, min_lines, PASSAGE_RESULTS)
