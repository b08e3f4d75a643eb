"""Report and message text as table jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from porescreen.functions.names import PLAIN_SYMBOLS, SYMBOLS

# The marks of a list, and how many heading marks a line may begin with.
LIST_MARKS, HEADING_MARKS = "-*•", 6


def sample_reports(original: DataFrame, features: DataFrame, name: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """One report text per sample: prediction, contributions by falling magnitude, raw features.

    Contributions are ordered inside the row, so the job is a join of two tables by name."""
    plain = {c: PLAIN_SYMBOLS.get(c, c) for c in columns}
    cells = F.array_sort(F.array(*[F.struct(
        (-F.abs(F.col(f"_s_{c}"))).alias("neg"), F.lit(i).alias("ord"),
        F.format_string(f"{plain[c]}=%+.4f", F.col(f"_s_{c}")).alias("text")) for i, c in enumerate(columns)]))
    shown = original.select(name, "orig_pred", "orig_base", *[F.col(c).alias(f"_s_{c}") for c in columns])
    raw = features.select(name, *columns)
    if limit is not None:
        shown = shown.orderBy(name).limit(limit)
    joined = shown.join(raw, name, "left")
    values = F.concat_ws(", ", *[F.format_string(f"{plain[c]}=%.6f", F.col(c)) for c in columns])
    lines = F.concat_ws(
        "\n", F.format_string("%s: Ds = %.4e", F.col(name), F.col("orig_pred")),
        F.format_string("  base=%.4f, pred=%.4f", "orig_base", "orig_pred"),
        F.concat(F.lit("  contributions: "), F.concat_ws(", ", F.transform(cells, lambda c: c["text"]))),
        F.concat(F.lit("  features: "), values))
    return joined.select(name, lines.alias("report"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def table_blocks(messages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Split message text into text and table blocks, in order.

    A table is a line with a pipe followed by a separator line (only dash, pipe, colon and blank,
    with a dash and a pipe), and then the lines that hold a pipe.  Inside a run of such lines the
    first header starts the table and the run ends it.  Blocks carry the text, or the header and
    the rows as cell lists.  The windows span one message, which already is one value of one row.
    """
    lines = messages.select(*keys, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    order = W.partitionBy(*keys).orderBy("n")
    piped = F.col("line").contains("|")
    bare = _strip(F.col("line"))
    separator = bare.rlike(r"^[-|: ]+$") & bare.contains("-") & bare.contains("|")
    marked = lines.withColumns({"_pipe": piped, "_next_sep": F.coalesce(F.lead(separator).over(order), F.lit(False))})
    starts = F.when(F.col("_pipe") & ~F.coalesce(F.lag("_pipe").over(order), F.lit(False)), 1).otherwise(0)
    marked = marked.withColumn("_run", F.sum(starts).over(order))
    in_run = W.partitionBy(*keys, "_run", "_pipe")
    head = F.min(F.when(F.col("_pipe") & F.col("_next_sep"), F.col("n"))).over(in_run)
    marked = marked.withColumn("_head", head).withColumn(
        "_table", F.coalesce(F.col("_pipe") & (F.col("n") >= F.col("_head")), F.lit(False)))
    change = F.when((F.lag("_table").over(order) != F.col("_table")) | F.lag("_table").over(order).isNull()
                    | (F.col("_table") & (F.col("n") == F.col("_head"))), 1).otherwise(0)
    marked = marked.withColumn("block_no", F.sum(change).over(order).cast("int"))
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace(bare, r"^\|", ""), r"\|$", ""), r"\|", -1), _strip)
    rows = F.when(F.col("_table") & (F.col("n") != F.col("_head") + 1), F.struct("n", cells.alias("cells")))
    blocks = marked.groupBy(*keys, "block_no", F.col("_table").alias("is_table")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("_table"), F.struct("n", "line")))).alias("_lines"),
        F.array_sort(F.collect_list(rows)).alias("_rows"))
    table = F.col("is_table")
    return blocks.select(
        *keys, "block_no", F.when(table, "table").otherwise("text").alias("kind"),
        F.when(~table, F.array_join(F.transform("_lines", lambda r: r["line"]), "\n")).alias("text"),
        F.when(table, F.col("_rows")[0]["cells"]).alias("header"),
        F.when(table, F.transform(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0))), lambda r: r["cells"])).alias("rows"))


def _line_text(line: Column) -> Column:
    """A line without white space around it, the list mark before a space, and up to six heading marks."""
    bare = _strip(line)
    listed = F.instr(F.lit(LIST_MARKS), F.substring(bare, 1, 1)) > 0
    bare = F.when(listed & F.substring(bare, 2, 1).rlike(r"\s"), _strip(F.substring(bare, 2, 1 << 30))).otherwise(bare)
    marks = F.least(F.length(bare) - F.length(F.ltrim(bare, F.lit("#"))), F.lit(HEADING_MARKS))
    return F.when(marks > 0, _strip(F.substring(bare, marks + 1, F.length(bare)))).otherwise(bare)


def plain_prose(text: Column) -> Column:
    """Message text without list markers, heading marks, emphasis stars and code ticks.

    Ticks go in pairs with something between them: the text is cut at its ticks and put together again in one pass, in which
    ``open`` tells that a tick was left out and waits for its partner."""
    starless = F.replace(F.array_join(F.transform(F.split(text, "\n"), _line_text), "\n"), F.lit("*"), F.lit(""))
    pieces = F.transform(F.split(starless, "`", -1), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def put(done: Column, piece: Column, n: Column) -> Column:
        opens = (piece["p"] != "") & (piece["i"] < n - 1)
        closed = F.struct(F.concat(done["text"], piece["p"]).alias("text"), F.lit(False).alias("open"))
        opened = F.struct(F.concat(done["text"], piece["p"]).alias("text"), F.lit(True).alias("open"))
        plain = F.struct(F.concat(done["text"], F.lit("`"), piece["p"]).alias("text"), F.lit(False).alias("open"))
        return F.when(done["open"], closed).when(opens, opened).otherwise(plain)

    return F.aggregate(pieces, start, lambda done, piece: put(done, piece, F.size(F.split(starless, "`", -1))))["text"]


def symbol_mentions(messages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Counts of descriptor symbols in text; longer symbols win, and neither edge may touch a word.

    The text falls into symbols that no letter or digit follows, runs of word characters, blanks and single other characters; a
    symbol counts unless what stands before it ends in a word character."""
    forms = sorted({*SYMBOLS.values(), *PLAIN_SYMBOLS.values()}, key=lambda s: (-len(s), s))
    token = "((?:" + "|".join(re.escape(f) for f in forms) + r")(?=[^A-Za-z0-9]|$)|\w+|\s+|[^\w\s])"
    tokens = messages.select(*keys, F.regexp_extract_all(text, F.lit(token), F.lit(1)).alias("_t"))
    known = F.array(*[F.lit(f) for f in forms])
    before = lambda i: F.when(i > 0, F.right(F.get("_t", i - 1), F.lit(1))).otherwise("")
    free = F.transform("_t", lambda t, i: F.when(F.array_contains(known, t) & ~before(i).rlike(r"\w"), t))
    found = tokens.select(*keys, F.explode(F.filter(free, lambda t: t.isNotNull())).alias("symbol"))
    return found.groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("n"))


def reassemble_stream(lines: DataFrame, keys: list[str], pos: str = "seq", line: str = "line") -> DataFrame:
    """Join streamed fragments per message: ``data:`` lines in order up to ``[DONE]``.

    Lines that are not valid JSON, and fragments without content, are skipped."""
    payload = F.trim(F.substring(F.trim(line), 6, 1 << 30))
    rows = lines.filter(F.trim(line).startswith("data:")).select(*keys, pos, payload.alias("_p"))
    piece = F.when(F.col("_p") != "[DONE]", F.get_json_object("_p", "$.choices[0].delta.content"))
    parts = rows.select(*keys, pos, (F.col("_p") == "[DONE]").alias("_end"), piece.alias("_c"))
    used = F.col("_end") | F.coalesce(F.col("_c") != "", F.lit(False))
    joined = parts.filter(used).groupBy(*keys).agg(
        F.min(F.when(F.col("_end"), F.col(pos))).alias("_stop"),
        F.array_sort(F.collect_list(F.when(~F.col("_end"), F.struct(pos, "_c")))).alias("_parts"))
    kept = F.filter("_parts", lambda r: F.col("_stop").isNull() | (r[pos] < F.col("_stop")))
    return joined.filter(F.size(kept) > 0).select(*keys, F.array_join(F.transform(kept, lambda r: r["_c"]), "").alias("text"))
