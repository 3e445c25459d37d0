"""Text normalisation as column expressions: they stay inside the JVM and fuse into one projection."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.schemas import LINE_WIDTH, MAX_HTML_CHARS, MAX_WORDS, SKIP

#: White space as str.strip() sees it.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Line ends as str.splitlines() sees them.
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
#: Openings of the signatures that phones append (fixed values).
MOBILE_SIGNATURES = ["Sent from my iPhone", "Sent from my iPad", "Sent from my Galaxy", "Sent from my Android"]
#: Named entities that are decoded, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def bind(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f names it: Catalyst would else copy c into each place."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def lines(c: Column) -> Column:
    """splitlines(): no trailing empty line, none for an empty text."""
    return bind(F.split(c, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def strip_data_uris(c: Column) -> Column:
    return F.regexp_replace(c, "data:[^;]+;base64,[A-Za-z0-9+/=]+", "")


def cap_html(c: Column) -> Column:
    return F.substring(strip_data_uris(c), 1, MAX_HTML_CHARS)


def html_cap_note(c: Column) -> Column:
    """Null unless data URIs or the cap shorten the text."""
    reduced = F.least(F.length(strip_data_uris(c)), F.lit(MAX_HTML_CHARS))
    kb = lambda n: F.floor(n / 1024).cast("string")
    return F.when(reduced < F.length(c), F.concat(F.lit("html "), kb(F.length(c)), F.lit("KB -> "), kb(reduced), F.lit("KB before parse")))


def _tidy(c: Column) -> Column:
    """One space where there are several; lines stripped, empty ones dropped."""
    return F.array_join(F.filter(F.transform(lines(F.regexp_replace(c, " +", " ")), strip), lambda x: x != ""), "\n")


def strip_html(c: Column) -> Column:
    """Visible text of HTML by regular expressions; null counts as empty."""
    x = cap_html(F.coalesce(c, F.lit("")))
    for tag in ("head", "style", "script"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    for pattern in (r"(?s)<!--.*?-->", r"<[!/?a-zA-Z][^>]*>"):
        x = F.regexp_replace(x, pattern, " ")
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return _tidy(x)


class _Text(HTMLParser):
    """Text nodes outside style, script and head."""

    HIDDEN = ("style", "script", "head")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.inside = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.inside:
            self.nodes.append(data)


@F.pandas_udf(T.StringType())
def _parsed_text(html: pd.Series) -> pd.Series:
    def one(x):
        p = _Text()
        p.feed(x or "")
        p.close()
        return " ".join(p.nodes)

    return html.map(one)


def strip_html_parsed(c: Column) -> Column:
    """Visible text by a real parser (an Arrow UDF): broken markup and every entity as a browser would read them."""
    return _tidy(_parsed_text(cap_html(F.coalesce(c, F.lit("")))))


def _before(parts: Column, hit) -> Column:
    """Elements before the first that hit holds for; all if none does."""

    def cut(parts: Column) -> Column:
        return bind(F.array_position(F.transform(parts, hit), True), lambda at: F.when(at > 0, F.slice(parts, F.lit(1), (at - 1).cast("int"))).otherwise(parts))

    return bind(parts, cut)


def remove_quoted_replies(c: Column) -> Column:
    """The text before the first quoted or attribution line, without blank lines at its end."""
    kept = _before(lines(c), lambda x: x.rlike("^On .+wrote:$") | x.startswith(">"))
    return F.regexp_replace(F.array_join(kept, "\n"), rf"(?:^|\n){SPACE}*\z", "")


def remove_forwarded(c: Column) -> Column:
    return rstrip(F.element_at(F.split(c, r"\n*-{5,}\s*Forwarded message\s*-{5,}", 2), 1))


def trim_signature(c: Column) -> Column:
    """Cut at the first line that is '--'; without one, at the first that a phone's signature opens."""
    opens = "^(?:" + "|".join(MOBILE_SIGNATURES) + ")"

    def cut(text: Column, parts: Column) -> Column:
        dash = F.array_position(F.transform(parts, lambda x: rstrip(x) == "--"), True)
        phone = F.array_position(F.transform(parts, lambda x: strip(x).rlike(opens)), True)
        at = bind(dash, lambda d: F.when(d > 0, d).otherwise(phone))
        return bind(at, lambda at: F.when(at > 0, rstrip(F.array_join(F.slice(parts, F.lit(1), (at - 1).cast("int")), "\n"))).otherwise(text))

    return bind(c, lambda text: bind(lines(text), lambda parts: cut(text, parts)))


def truncate_words(c: Column, most: int = MAX_WORDS) -> Column:
    cut = lambda text: bind(words(text), lambda w: F.when(F.size(w) <= most, text).otherwise(F.array_join(F.slice(w, 1, most), " ")))
    return bind(c, cut)


def normalise_body(html: Column, parsed: bool = False) -> Column:
    """HTML, forwards, quotes, signature, length: in this order."""
    return truncate_words(trim_signature(remove_quoted_replies(remove_forwarded((strip_html_parsed if parsed else strip_html)(html)))))


def text_representation(name: Column, address: Column, subject: Column, body: Column, list_id: Column | None = None) -> Column:
    """'name <address> | subject | body', with '[list: id]' at the end if there is one; nulls count as empty."""
    n, a, s, b, i = (F.coalesce(x, F.lit("")) for x in (name, address, subject, body, F.lit("") if list_id is None else list_id))
    sender = F.when(n != "", F.concat(n, F.lit(" <"), a, F.lit(">"))).otherwise(F.concat(F.lit("<"), a, F.lit(">")))
    return F.concat_ws(" | ", sender, s, b, F.when(i != "", F.concat(F.lit("[list: "), i, F.lit("]"))))


def truncate_line(c: Column, width: int = LINE_WIDTH) -> Column:
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, width - 6), F.lit(" [...]")))


def format_ms(ms: Column) -> Column:
    """UTC time of epoch milliseconds with the number itself, or '-'. The session's time zone must be UTC."""
    return F.coalesce(F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(" ("), ms.cast("string"), F.lit(" ms)")), F.lit("-"))


def index_label(label_id: Column, label_name: Column) -> Column:
    return F.when(label_id == SKIP, label_id).otherwise(F.coalesce(F.nullif(label_name, F.lit("")), label_id))
