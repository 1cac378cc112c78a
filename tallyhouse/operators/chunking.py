"""Split Markdown documents into sections by heading, each document inside its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import strip

# Everything that ends a line, besides the plain line feed.
LINE_ENDS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
TITLE, SECTION = "# ", "## "


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _heading(line: Column, mark: str) -> Column:
    return strip(F.substring(line, F.lit(len(mark) + 1), F.length(line)))


def _section(lines: Column) -> Column:
    """What one part of a document says: its own heading, its last title, its body."""
    titles = F.filter(lines, lambda x: x.startswith(TITLE))
    body = F.filter(lines, lambda x: ~x.startswith(TITLE) & ~x.startswith(SECTION))
    first = F.get(lines, F.lit(0))
    return F.struct(
        F.when(first.startswith(SECTION), _heading(first, SECTION)).alias("own_heading"),
        _heading(F.try_element_at(titles, F.lit(-1)), TITLE).alias("title"),
        strip(F.array_join(body, "\n")).alias("text"),
    )


def chunk_markdown(documents: DataFrame) -> DataFrame:
    """Sections of each document (``doc``, ``text``): doc, position, title, heading, text.

    A section runs from one "## " line to the next. A "# " line sets the title from there on and
    is the heading of the section it stands in. Sections without text are left out.
    Nothing is shuffled: a document is one row, and its sections leave it by ``inline_outer`` (the
    plain form would be tested for size further down and so be worked out twice).
    """
    text = F.regexp_replace(F.col("text"), LINE_ENDS, "\n")
    parts = F.split(text, r"\n(?=## )")
    return (
        documents.select(F.col("doc").cast("string").alias("doc"), parts.alias("parts"))
        .select("doc", F.transform(F.transform("parts", _lines), _section).alias("sections"))
        .select("doc", "sections", _title_starts("sections").alias("starts"))
        .select("doc", F.inline_outer(_with_titles("sections", "starts")))
        .select(
            "doc",
            "position",
            F.coalesce("title", "doc").alias("title"),
            F.coalesce("heading", "doc").alias("heading"),
            "text",
        )
        .filter(F.col("text") != "")
    )


def _title_starts(sections: str) -> Column:
    """Positions where a title takes effect; position 0 always starts a stretch."""
    marked = F.transform(sections, lambda s, i: F.when((i == 0) | s["title"].isNotNull(), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _with_titles(sections: str, starts: str) -> Column:
    """Sections with the title in force: each stretch carries the title at its start."""
    all_sections, all_starts = F.col(sections), F.col(starts)

    def stretch(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get(all_starts, n + 1), F.size(all_sections))
        title = F.get(all_sections, start)["title"]

        def section(s: Column, i: Column) -> Column:
            return F.struct(
                (start + i).alias("position"),
                title.alias("title"),
                F.coalesce(s["title"], s["own_heading"]).alias("heading"),
                s["text"].alias("text"),
            )

        return F.transform(F.slice(all_sections, start + 1, end - start), section)

    return F.flatten(F.transform(all_starts, stretch))
