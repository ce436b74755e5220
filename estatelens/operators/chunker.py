"""Cutting of long documents in linear time, as a table function on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the column functions trim it.
BLANK = " \t\n\x0b\f\r"
_HEADING = re.compile(r"(?=\n#{1,4}[ \t\n\x0b\f\r])")
_GAP = {"\n\n": re.compile(r"\n\n+"), "\n": re.compile(r"\n+")}


def fits(chars: int, most: int) -> bool:
    return -(-chars // 4) <= most


def cut(text: str | None, most: int, overlap: int, sep: str) -> list[str]:
    """Chunks of a text, as ``index.chunk_documents`` gives them; each paragraph is looked at once."""
    pieces: list[str] = []
    for section in _HEADING.split(text or ""):
        section = section.strip(BLANK)
        if not section:
            continue
        if fits(len(section), most):
            pieces.append(section)
            continue
        held: list[str] = []
        size, code = 0, False
        for paragraph in _GAP[sep].split(section):
            code ^= "```" in paragraph
            joined = size + len(sep) + len(paragraph) if size else len(paragraph)
            if not (fits(joined, most) or code):
                if size:
                    pieces.append(sep.join(held).strip(BLANK))
                held, joined = [], len(paragraph)
            held.append(paragraph)
            size = joined
            if not size:
                held.clear()  # an empty paragraph leaves nothing that the next one joins
        if last := sep.join(held).strip(BLANK):
            pieces.append(last)
    tail = 4 * overlap
    return [p if not k else f"{pieces[k - 1][-tail:] if tail else ''}\n\n{p}".strip(BLANK) for k, p in enumerate(pieces)]


def cut_documents(docs: DataFrame, max_tokens: int = 500, overlap: int = 50, sep: str = "\n\n") -> DataFrame:
    """(url, chunk_index, content) of (url, text, ...), as ``index.chunk_documents``: for texts of any length.

    A table function on Arrow batches of the table, each partition by itself (Spark has no lateral
    join with such functions). Chunks leave it document by document; a null text has none.
    """

    @F.arrow_udtf(returnType="url string, chunk_index int, content string")
    class Cut:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for url, text in zip(batch.column("url"), batch.column("text"), strict=True):
                found = cut(text.as_py(), max_tokens, overlap, sep)
                yield pa.table({"url": pa.repeat(url, len(found)), "chunk_index": pa.array(range(len(found)), pa.int32()), "content": pa.array(found, pa.string())})

    return Cut(docs.select(F.col("url").cast("string").alias("url"), "text").asTable())
