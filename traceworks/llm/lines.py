"""Line dedup with a segment-partition edit join, in built-in expressions only.

A line repeats if an earlier line (smaller id, or earlier in the same document) equals it or, both having ``least``
characters or more, differs by at most ``edits`` insertions, deletions and replacements of characters. Lines are judged
on the input, not on what is left.

Every distinct line is cut into ``edits + 1`` segments; a line within the threshold holds one of them unchanged, at an
offset that the two lengths bound. Segments are indexed by (number, line length, content), the substrings that can
match are probed by length and offset, and pairs that meet are verified by a banded bit-parallel edit distance. Equal
lines are one entry of the join, at their earliest place, so the number of copies bears on nothing. Of many lines that
share a segment, a pair leaves the join only if counts of its characters allow so few edits, so that no list of all
their pairs is made.

Lines shorter than ``least`` characters are compared for equality only: two edits make other words of a short line, and
the join would meet most pairs of them. Blank lines shorter than that are left alone. Defined results: null and empty texts have one empty line;
rows equal in id and text are one document and each is returned; rows that share only the id are ordered by a digest of
the text; a null id sorts first; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceworks.llm.common import SPACES, boxed, keyed, with_list, written

EDITS, LEAST = 2, 32
#: Lines that hold more than one in so many of all lines are frequent; there are fewer of them than that.
HOT = 100_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def with_cuts(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``lines`` (line, size) with ``cut_d_i``: where segment i starts in lines shorter by d, i = edits + 1 being the end.

    They are columns of their own, so that the key expressions stay small enough to be compiled.
    """
    parts = edits + 1
    return lines.withColumns({f"cut_{d}_{i}": F.expr(f"int((size - {d}) * {i} div {parts})")
                              for d in range(edits + 1) for i in range(parts + 1)})


def _key(shorter: int, number: int, start: Column) -> Column:
    """Key of the substring from ``start`` that is as long as a segment of lines shorter by so much."""
    size = F.col(f"cut_{shorter}_{number + 1}") - F.col(f"cut_{shorter}_{number}")
    return F.xxhash64((F.col("size") - shorter) * 64 + number, F.substring("line", start + 1, size))


def index_keys(edits: int = EDITS) -> list[Column]:
    """The segments of a line of ``with_cuts`` as keys."""
    return [_key(0, i, F.col(f"cut_0_{i}")) for i in range(edits + 1)]


def probe_keys(edits: int = EDITS) -> list[Column]:
    """Keys of all substrings that can equal a segment of a line as long or up to ``edits`` shorter.

    The i-th segment can have moved by at most i places seen from the left, and by what the other segments leave of
    the edits seen from the right. Lines of ``with_cuts`` are long enough that no substring leaves them.
    """
    return [_key(d, i, F.col(f"cut_{d}_{i}") + move) for d in range(edits + 1) for i in range(edits + 1)
            for move in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)]


def banded_distance(a: Column, b: Column, most: int = EDITS) -> Column:
    """Edit distance of two texts if it is at most ``most``, else a larger number.

    One bit per diagonal of the band: bit d of a column's vectors stands for the row d - most below the diagonal. Both
    texts need more than ``most`` characters, and their lengths may differ by no more than that.
    """
    width = 2 * most + 1
    every = F.lit((1 << width) - 1).cast("long")

    def characters(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))

    def bit(x: Column, place: Column) -> Column:
        return F.call_function("shiftright", x, place).bitwiseAND(F.lit(1).cast("long"))

    def run(rows: Column, columns: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            equal = F.lit(0).cast("long")
            for d in range(width):
                same = F.coalesce(F.get(rows, i + (d - most)) == F.get(columns, i), F.lit(False))
                equal = equal + F.when(same, F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long"))

            def move(eq: Column) -> Column:
                up, down = s["up"], s["down"]
                zero = (eq.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(eq).bitwiseOR(down).bitwiseAND(every)
                return let(zero, lambda z: let(F.struct(
                    down.bitwiseOR(F.bitwise_not(z.bitwiseOR(up)).bitwiseAND(every)).alias("plus"),
                    z.bitwiseAND(up).alias("minus"), F.shiftright(z, 1).alias("half"), z.alias("zero")), after))

            def after(h: Column) -> Column:
                past = i - (F.size(rows) - most)
                side = F.lit(2 * most - 1) - past
                change = F.when(past < 0, F.lit(1).cast("long") - bit(h["zero"], F.lit(2 * most))).otherwise(
                    bit(h["plus"], side) - bit(h["minus"], side))
                return F.struct(
                    h["minus"].bitwiseOR(F.bitwise_not(h["half"].bitwiseOR(h["plus"])).bitwiseAND(every)).alias("up"),
                    h["half"].bitwiseAND(h["plus"]).alias("down"), (s["distance"] + change).alias("distance"))

            return let(equal, move)

        start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("up"), F.lit(0).cast("long").alias("down"),
                         F.lit(most).cast("long").alias("distance"))
        return F.aggregate(F.sequence(F.lit(0), F.size(columns) - 1), start, step, lambda s: s["distance"])

    return let(characters(a), lambda rows: let(characters(b), lambda columns: run(rows, columns)))


#: Classes of characters that are counted; any disjoint ones would do, the more of them the sharper the signature.
CLASSES = ("a", "e", "i", "o", "u", "n", "r", "s", "t", "l", "h", "d", "[cm]", "[pb]", "[gv]", "[wfy]", "[éèê]", "[ñáíóúü]")


def signature(line: Column) -> Column:
    """How many characters of each class a text has. One edit changes these counts by two at most, taken together."""
    return F.struct(*[F.regexp_count(line, F.lit(c)).alias(f"c{k}") for k, c in enumerate(CLASSES)])


def _may_be_near(a: str, b: str, edits: int) -> Column:
    apart = sum((F.abs(F.col(f"{a}.c{k}") - F.col(f"{b}.c{k}")) for k in range(len(CLASSES))), F.lit(0))
    return apart <= 2 * edits


def _met(lines: DataFrame, edits: int) -> DataFrame:
    """(key, id, is_segment): segments and probes of the lines (id, line, size) whose key another line's has too.

    Segments and probes are dealt out by key together, once. Ids are even; in the exchange their lowest bit says which
    of the two it is, and a key is cut to 48 bits, as what meets by chance is verified like all that meets.
    """
    odd, even, short = (F.lit(x).cast("long") for x in (1, -2, (1 << 48) - 1))
    keys = F.array(*index_keys(edits), *probe_keys(edits))
    rows = with_cuts(lines, edits).select("id", F.posexplode(keys).alias("number", "key")).select(
        F.col("key").bitwiseAND(short).alias("key"),
        F.when(F.col("number") <= edits, F.col("id").bitwiseOR(odd)).otherwise(F.col("id")).alias("id"))
    one, own, is_segment = Window.partitionBy("key"), F.col("id").bitwiseAND(even), F.col("id").bitwiseAND(odd) == 1
    # Most keys belong to one line; the few others also need both sides.
    several = rows.withColumns({"least": F.min("id").over(one), "most": F.max("id").over(one)}).where(
        F.col("least").bitwiseAND(even) != F.col("most").bitwiseAND(even)).select("key", "id")
    sides = several.withColumns({"r": F.max(F.when(is_segment, own)).over(one), "s": F.max(F.when(~is_segment, own)).over(one)})
    return sides.where("r is not null and s is not null").select("key", own.alias("id"), is_segment.alias("is_segment"))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, tag, line_no, line, id, size) of the lines that are judged."""
    line = F.col("line")
    return docs.select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(
        (F.length(line) >= least) | (F.regexp_replace(line, SPACES, "") != "")).withColumns(
        {"id": F.xxhash64(line).bitwiseAND(F.lit(-2).cast("long")), "size": F.length(line)})


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, tag, line_no) of every line to remove; ``docs`` as ``keyed`` gives them.

    Texts are dealt out once, as whole documents; all else travels as hashes and places.
    """
    rows = written(_lines(docs, least).drop("line"), "lines")
    place = F.struct("doc_id", "tag", "line_no")
    # Every distinct line at its first place; no more than HOT of them are this frequent.
    first = rows.groupBy("id").agg(F.min(place).alias("at"))
    often = rows.groupBy("id").count().where(F.col("count") > rows.count() / HOT).select("id")
    hot = rows.join(F.broadcast(often), "id", "left_semi").groupBy("id").agg(F.min(place).alias("at")).select(
        F.col("id").alias("hot_id"), "at")
    # Segments and probes of the longer lines that meet another line's; frequent lines at their first place only.
    longer = _lines(docs, least).where(F.col("size") >= least).join(F.broadcast(hot), F.col("id") == F.col("hot_id"), "left")
    longer = longer.where(F.col("at").isNull() | F.col("at").eqNullSafe(place)).select("id", "line", "size")
    met = written(_met(longer, edits).distinct(), "met")
    # Their texts, looked up at their first places. Signatures keep pairs that are too far apart inside the join.
    wanted = first.join(met.select("id").distinct(), "id", "left_semi")
    asked = with_list(docs, wanted.select("at.doc_id", "at.tag", "at.line_no", "id"), "asked").where("asked is not null")
    # The id goes along, so that the exchange of the texts is the one that the result is made from.
    texts = asked.select("doc_id", F.split("text", "\n").alias("lines"), "asked").select(F.inline(F.transform(
        "asked", lambda a: F.struct(a["id"].alias("id"), F.get("lines", a["line_no"]).alias("line"),
                                    F.col("doc_id").alias("of"))))).select("id", "line")
    marked = met.join(texts, "id").select("key", "id", "is_segment", signature(F.col("line")).alias("mark"))
    r = marked.where("is_segment").select("key", F.col("id").alias("r"), F.col("mark").alias("r_mark"))
    s = marked.where("not is_segment").select("key", F.col("id").alias("s"), F.col("mark").alias("s_mark"))
    pairs = r.alias("x").join(s.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("r") != F.col("s"))
                              & _may_be_near("r_mark", "s_mark", edits)).select("r", "s").distinct()
    verified = pairs.join(texts.select(F.col("id").alias("r"), F.col("line").alias("r_line")), "r").join(
        texts.select(F.col("id").alias("s"), F.col("line").alias("s_line")), "s").where(
        banded_distance(F.col("r_line"), F.col("s_line"), edits) <= edits).select("r", "s")
    placed = verified.join(first.select(F.col("id").alias("r"), F.col("at").alias("r_at")), "r").join(
        first.select(F.col("id").alias("s"), F.col("at").alias("s_at")), "s")
    near = placed.select(F.when(F.col("r_at") < F.col("s_at"), F.col("s")).otherwise(F.col("r")).alias("id")).distinct()
    judged = first.select("id", "at").join(near.withColumn("near", F.lit(True)), "id", "left")
    n = rows.select("doc_id", "tag", "line_no", "id").alias("n")
    return n.join(judged, "id").where(F.coalesce("near", F.lit(False)) | ~(
        F.col("n.doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("n.tag") == F.col("at.tag"))
        & (F.col("n.line_no") == F.col("at.line_no")))).select("n.doc_id", "n.tag", "n.line_no").distinct()


def kept_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose numbers are in ``removed``."""
    return F.array_join(F.transform(F.filter(F.transform(
        F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda e: ~F.array_contains(removed, e["i"])), lambda e: e["x"]), "\n")


def with_removed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (doc_id, tag, ..) with ``removed``: the numbers of its repeated lines, ascending."""
    return with_list(docs, gone, "removed").withColumn(
        "removed", F.sort_array(F.coalesce("removed", F.array().cast("array<int>"))))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): every document without its repeated lines."""
    docs = keyed(docs, id_col, text_col)
    rows = with_removed(docs, repeated_lines(docs, edits, least))
    return rows.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
                       F.size("removed").cast("long").alias("n_removed"),
                       F.when(F.size("removed") == 0, F.col("text")).otherwise(
                           kept_lines(F.col("text"), F.col("removed"))).alias("kept"))


def without_repeats(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id",
                    text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of the text and ``size_col``, if there, counted anew.

    A document of which only blank lines are left goes: others hold what it says. Untouched documents stay exactly as
    they are.
    """
    columns = docs.columns
    touched = F.size("removed") > 0
    rows = boxed(docs, id_col, text_col)
    gone = repeated_lines(rows.select("doc_id", "tag", "text"), edits, least)
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    rows = with_removed(rows.drop("text"), gone).withColumn("kept", kept_lines(text, F.col("removed")))
    rows = rows.where(~touched | (F.regexp_replace("kept", SPACES, "") != ""))
    changed = {text_col: F.col("kept"), size_col: F.length("kept").cast("long")}
    return rows.select(*[
        (F.when(touched, changed[c]).otherwise(F.col("row")[c]) if c in changed else F.col("row")[c]).alias(c)
        for c in columns])
