"""Main text of HTML pages: blocks labelled by the recurrent labeller, joined in page order.

Defined cases: null or empty html has no blocks and gives an empty text; so do pages without main text. Repeated rows
and null ids stay as they are. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import blocks
from .html_lstm import Labeller, pretrained

#: Pages, and characters of them, that are parsed before their blocks are labelled.
TOGETHER, CHARACTERS = 256, 8 << 20


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    parsed = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, main in zip(found, chosen.tolist(), strict=True) if main) for found, chosen in zip(parsed, model.main_blocks(parsed), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. Without a ``model`` the kept weights serve."""
    labeller = model or pretrained()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch["html"]).to_numpy()) // CHARACTERS
            cuts = np.unique(np.concatenate([[0, batch.num_rows], np.flatnonzero(np.diff(size)) + 1, np.arange(0, batch.num_rows, TOGETHER)])).tolist()
            for at, to in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(at, to - at)
                found = main_texts(part["html"].to_pylist(), labeller)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
