"""Rules for raw model answers, prompts, data URIs and mail bodies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhire.functions.text import trimmed

# File extension to MIME type.
MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
    "svg": "image/svg+xml", "txt": "text/plain", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
PDF_PREFIX = "data:application/pdf;base64,"


def without_fences(raw: Column) -> Column:
    """Deletes every ```json, then every ```, then trims."""
    return trimmed(F.replace(F.replace(raw, F.lit("```json")), F.lit("```")))


def _strict_json_udf():
    # made in a function, so that it is sent to the workers whole, not as a name to import there
    def parses(text: str | None) -> bool:
        def no_constant(name: str) -> None:
            raise ValueError(name)

        try:
            json.loads(text or "", parse_constant=no_constant)
        except (ValueError, RecursionError):
            return False
        return True

    def run(text: pd.Series) -> pd.Series:
        return text.map(parses).astype(bool)

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.BooleanType())


def is_strict_json(text: Column | str) -> Column:
    """Whether a text is one JSON value and nothing else. Spark's own parsers accept what trails a value."""
    return _strict_json_udf()(text)


def mime_of(name: Column) -> Column:
    """By the extension of a file name; octet-stream where it is unknown."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension), F.lit("application/octet-stream"))


def one_line_base64(content: Column) -> Column:
    """Base64 without the line breaks that Spark puts in."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def data_uri(name: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_of(name), F.lit(";base64,"), one_line_base64(content))


def decoded_pdf(value: Column) -> Column:
    """The bytes behind exactly the PDF prefix (or none); null for what is no base64."""
    return F.try_to_binary(F.regexp_replace(value, f"^{PDF_PREFIX}", ""), F.lit("base64"))


def career_prompt(skills: Column) -> Column:
    """Our prompt around the comma-joined skills; null without a list."""
    return F.when(skills.isNotNull(), F.concat(F.lit("Suggest careers for someone with these skills: "), F.array_join(skills, ",")))


def escaped_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def rendered(template: str, escape: bool = False, **values: Column) -> Column:
    """A template with its {name} marks replaced everywhere."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), escaped_html(value) if escape else value)
    return out
