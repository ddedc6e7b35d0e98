"""Web pages as ordered text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.scalars import strip


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, line): scripts, styles, menus and footers removed, blocks as lines, tags stripped, common entities decoded."""
    x = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b.*?</(script|style|nav|footer)>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)</?(p|div|h[1-6]|li|br|tr|article|section)\b[^>]*>", "\n"), "<[^>]*>", "")
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(text))
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda line: line != "")
    return pages.select("page_id", F.posexplode(lines).alias("line_no", "line"))
