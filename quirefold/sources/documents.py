"""Document files by injected readers: information, rendered pages, settings with defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import canvas as C

#: Resolutions that pages are rendered at; fixed values.
LEAST_DPI, MOST_DPI = 1, 600

#: Page count and title of a document's bytes.
Probe = Callable[[bytes], tuple[int, str | None]]
#: Bytes of a picture of a page (from 1) at a scale in pixels a point.
Renderer = Callable[[bytes, int, float], bytes]


def information(files: DataFrame, probe: Probe) -> DataFrame:
    """(path, page_count, title, error) of files (path, content); blank titles are null, a failing probe's words the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    pages, title = probe(bytes(content))
                    rows.append((path, pages, (title or "").strip() or None, None))
                except Exception as e:  # whatever the injected probe raises is that file's error
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page_count", "title", "error"]).astype({"page_count": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, page_count long, title string, error string")


def render_plan(requests: DataFrame) -> DataFrame:
    """requests (page, dpi, width_pt, height_pt, page_count, most) with fault and scale.

    A resolution from 1 to 600 and a page that the document has are asked for; most (or null) limits the long edge.
    """
    fault = F.when(~F.col("dpi").between(LEAST_DPI, MOST_DPI), "dpi").when(~F.col("page").between(1, F.col("page_count")), "page")
    scale = C.render_scale(F.col("width_pt"), F.col("height_pt"), F.col("dpi"), F.col("most"))
    return requests.withColumn("fault", fault).withColumn("scale", F.when(F.col("fault").isNull(), scale))


def rendered(plan: DataFrame, files: DataFrame, renderer: Renderer) -> DataFrame:
    """(path, page, picture) of the rows of a render plan (path, page, scale) without fault."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "page": pdf["page"], "picture": [renderer(bytes(c), int(p), float(s)) for c, p, s in zip(pdf["content"], pdf["page"], pdf["scale"])]})

    rows = plan.filter("fault is null").select("path", "page", "scale").join(files.select("path", "content"), "path")
    return rows.mapInPandas(run, "path string, page long, picture binary")


def with_defaults(settings: dict[str, Any] | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """Stored settings over the defaults; nothing stored gives the defaults, unknown names are left out."""
    return {name: (settings or {}).get(name, value) if (settings or {}).get(name) is not None else value for name, value in defaults.items()}
