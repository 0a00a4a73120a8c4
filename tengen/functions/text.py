"""Text Columns: whitespace, defaults, URI and markup decoding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the whitespace class of web text (wider than Java's \s)
WS = (r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
      r"\x{205F}\x{3000}\x{FEFF}]")

# the same characters, for trimming without a search through the whole text
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# fixed values: entities decoded, in this order
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
            ("&lt;", "<"), ("&gt;", ">")]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col(c), F.lit(""))


def first_text(*cols) -> Column:
    """First non-empty value, else ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def strip_ws(c) -> Column:
    return F.regexp_replace(text(c), WS + "+", "")


def trim_ws(c) -> Column:
    return F.btrim(text(c), F.lit(WS_CHARS))


def date_only(c) -> Column:
    """Leading YYYY-MM-DD, else ''."""
    return F.regexp_extract(text(c), r"^\d{4}-\d{2}-\d{2}", 0)


def date10(c) -> Column:
    return F.substring(text(c), 1, 10)


def event_text(*cols) -> Column:
    """Fields joined by blanks, for the keyword tests on an event."""
    return F.concat_ws(" ", *[text(c) for c in cols])


def uri_decode(c) -> Column:
    """Percent decoding that keeps '+', and keeps the input when it is malformed."""
    src = text(c)
    out = F.try_url_decode(F.replace(src, F.lit("+"), F.lit("%2B")))
    broken = F.contains(out, F.lit("�")) & ~F.contains(src, F.lit("�")) \
        & ~F.contains(F.upper(src), F.lit("%EF%BF%BD"))
    return F.when(out.isNull() | broken, src).otherwise(out)


def decode_entities(c, entities=ENTITIES) -> Column:
    out = col(c)
    for token, char in entities:
        out = F.replace(out, F.lit(token), F.lit(char))
    return out


def strip_html(c) -> Column:
    """Visible text: no script/style bodies, no tags, entities decoded, blanks collapsed."""
    t = F.regexp_replace(text(c), r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = decode_entities(F.regexp_replace(t, WS + "+", " "))
    return trim_ws(F.regexp_replace(t, WS + "+", " "))


def notice_text(c) -> Column:
    return strip_html(uri_decode(c))


def notice_payload_text(c) -> Column:
    """A landed notice: a JSON list of titled sections, or plain (encoded) markup."""
    raw = text(c)
    sections = F.from_json(raw, "array<struct<t:string,h:string>>", {"mode": "PERMISSIVE"})
    joined = F.array_join(
        F.transform(sections, lambda s: F.concat(text(s["t"]), F.lit(": "), notice_text(s["h"]))),
        "\n")
    return F.when(raw == "", F.lit("")).when(
        raw.rlike(rf"^{WS}*\[") & sections.isNotNull(), trim_ws(joined)
    ).otherwise(notice_text(raw))


def shorten(c, n: int) -> Column:
    """Title cut for display."""
    return F.when(F.length(text(c)) > n, F.concat(F.substring(text(c), 1, n), F.lit("…"))) \
        .otherwise(text(c))


def record_text(win, lose, draw) -> Column:
    w, l, d = (F.coalesce(col(x), F.lit(0)) for x in (win, lose, draw))
    return F.concat(w.cast("string"), F.lit("胜"), l.cast("string"), F.lit("负"),
                    F.when(d > 0, F.concat(d.cast("string"), F.lit("和"))).otherwise(F.lit("")))
