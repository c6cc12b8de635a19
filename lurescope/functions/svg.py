"""Static inspection of SVG images that carry script."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of what an image can run.
NAME = r"(?:[a-zA-Z][\w-]*:)?script\b"
SCRIPT = rf"(?i)<\s*{NAME}"
SCRIPT_SOURCE = rf"(?is)<\s*{NAME}[^>]*?\s(?:xlink:href|href|src)\s*=\s*[\"']([^\"']+)[\"']"
SCRIPT_BODY = rf"(?is)<\s*{NAME}[^>]*>(.*?)<\s*/\s*{NAME}\s*>"
HANDLER = r"(?i)\bon[a-z]+\s*=\s*[\"']([^\"']+)[\"']"
INLINE_URL = r"['\"`](https?://[^\s'\"`<>\]\\]{8,})['\"`]"
# Marks of obfuscated script, by name.
OBFUSCATION = {
    "fromcharcode": r"(?i)\.fromCharCode\s*\(", "atob": r"(?i)\batob\s*\(", "eval": r"(?i)\beval\s*\(", "new_function": r"(?i)\bnew\s+Function\s*\(",
    "unescape": r"(?i)\bunescape\s*\(", "document_write": r"(?i)\bdocument\.write\s*\(",
}


def inspect(svg: Column) -> Column:
    """Struct of findings; ``is_suspicious`` if anything can run."""
    bodies = F.filter(F.regexp_extract_all(svg, F.lit(SCRIPT_BODY), F.lit(1)), lambda b: F.trim(b) != "")
    sources = F.regexp_extract_all(svg, F.lit(SCRIPT_SOURCE), F.lit(1))
    handlers = F.slice(F.regexp_extract_all(svg, F.lit(HANDLER), F.lit(1)), 1, 20)
    use = F.regexp_extract_all(svg, F.lit(r"(?is)<\s*use\b[^>]*?(?:xlink:href|href)\s*=\s*[\"'](https?://[^\"']+)[\"']"), F.lit(1))
    flags = {
        "has_script": svg.rlike(SCRIPT), "has_inline_script": F.size(bodies) > 0, "has_external_script": F.size(sources) > 0, "has_event_handler": F.size(handlers) > 0,
        "has_javascript_url": svg.rlike(r"(?i)(?:href|src|xlink:href)\s*=\s*[\"']\s*javascript:"), "has_foreign_content": svg.rlike(r"(?i)<\s*(?:foreignObject|iframe)\b"), "has_external_use": F.size(use) > 0,
    }
    script = F.array_join(F.concat(bodies, handlers), "\n")
    marks = F.array_compact(F.array(*(F.when(script.rlike(p), m) for m, p in OBFUSCATION.items())))
    return F.struct(
        *(v.alias(k) for k, v in flags.items()), sources.alias("script_src_urls"), F.array_distinct(F.regexp_extract_all(script, F.lit(INLINE_URL), F.lit(1))).alias("inline_urls"), use.alias("use_urls"),
        handlers.alias("handlers"), marks.alias("obfuscation"), reduce(lambda a, b: a | b, flags.values()).alias("is_suspicious"),
    )
