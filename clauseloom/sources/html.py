"""Pages: visible text and how a page can be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named characters that are written out, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
_HIDDEN = [r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<noscript[^>]*>.*?</noscript>"]


def visible_text(page: Column) -> Column:
    """Text between tags, without scripts, styles and what shows without scripts; white space as single spaces."""
    out = page
    for pattern in _HIDDEN:
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def visible_text_sql(page: str) -> str:
    out = page
    for pattern in _HIDDEN:
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in ENTITIES:
        quoted = char.replace("'", "''")
        out = f"replace({out}, '{name}', '{quoted}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1)


def diagnose(status: Column, allowed: Column, has_body: Column) -> Column:
    """blocked where robots say so or the server refuses, http where the page itself has the text, else browser."""
    return F.when(~allowed | status.isin(401, 403, 429), "blocked").when((status == 200) & has_body, "http").otherwise("browser")


def body_marker(body: Column) -> Column:
    """25 characters, without spaces, of the first line of 40 or more that is no table line; tells whether a page holds the body."""
    lines = F.filter(F.split(body, "\n"), lambda s: (F.length(s) >= 40) & ~s.startswith("|"))
    return F.substring(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"\s+", ""), 1, 25)
