"""Decoding, tokenizing, tags and path predicates."""

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: an identifier of two or more characters. A one-character
# identifier is never wanted, so the length filter is part of the pattern.
IDENTIFIER = "[A-Za-z_][A-Za-z_0-9]+"

# Fixed value: the well-formed multi-byte UTF-8 sequences (Unicode, table 3-7),
# spelled over a Latin-1 view of the bytes.
WELL_FORMED = (
    r"[\xC2-\xDF][\x80-\xBF]"
    r"|\xE0[\xA0-\xBF][\x80-\xBF]"
    r"|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}"
    r"|[\xF1-\xF3][\x80-\xBF]{3}"
    r"|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)

MIN_TOKENS = 5


def decode_source(content: Column) -> Column:
    """UTF-8 text of a binary column with ill-formed bytes left out.

    Valid content is a plain cast; only invalid content pays for the regex,
    which drops every byte >= 0x80 outside a well-formed sequence.
    """
    as_text = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    repaired = F.regexp_replace(latin, f"({WELL_FORMED})|[\\x80-\\xFF]", "$1")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(
        F.encode(repaired, "ISO-8859-1").cast("string")
    )


def tokenize(text: Column) -> Column:
    """Lower-cased ASCII identifiers in order of appearance, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), F.lower)


def make_tag(prefix: Column, path: Column) -> Column:
    """``prefix/path``, or just ``path`` when the prefix is null or empty."""
    return F.concat_ws("/", F.nullif(prefix, F.lit("")), path)


def repo_name(url: Column) -> Column:
    """Last URL component with every ``.git`` removed."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".git"), F.lit(""))


def strip(text: Column) -> Column:
    """Trim all leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def top_component(tag: Column) -> Column:
    return F.substring_index(tag, "/", 1)


def has_extension(path: Column, extensions: list[str]) -> Column:
    """True when the file name matches ``*{ext}`` for any extension."""
    name = F.substring_index(path, "/", -1)
    matches = F.lit(False)
    for ext in extensions:
        if re.search(r"[*?\[]", ext):
            pattern = fnmatch.translate("*" + ext)
            matches = matches | name.rlike("^" + re.sub(r"\\[zZ]$", "", pattern) + r"\z")
        else:
            matches = matches | name.endswith(ext)
    return matches


def filter_extensions(df: DataFrame, extensions: list[str], path: str = "path") -> DataFrame:
    """Rows whose file matches; a file matching two extensions stays one row."""
    return df.filter(has_extension(F.col(path), extensions))


def filter_source_dir(df: DataFrame, source_dir: str | None, path: str = "path") -> DataFrame:
    """Rows below ``source_dir``; ``src1`` does not take ``src10``."""
    if not source_dir:
        return df
    return df.filter(F.col(path).startswith(source_dir.rstrip("/") + "/"))


def prepare_documents(
    files: DataFrame,
    text: Column,
    prefix: Column,
    path: Column,
    keep: list[str] | None = None,
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """Tokenize, keep documents with more than ``min_tokens`` tokens, tag them.

    One narrow stage. ``keep`` names input columns to carry along. The length
    test sits inside a generator: as a plain filter it would be pushed below
    the projection and every file would be tokenized twice.
    """
    carried = [F.col(c) for c in keep or []]
    candidate = F.array(F.struct(tokenize(text).alias("words")))
    long_enough = F.filter(candidate, lambda d: F.size(d["words"]) > min_tokens)
    return files.select(make_tag(prefix, path).alias("tag"), *carried, F.inline(long_enough))
