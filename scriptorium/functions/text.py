"""Text expressions that stay inside Spark's generated code."""

from __future__ import annotations

from string import ascii_letters, digits, whitespace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts on the web know it: Unicode's, and the byte order mark.
_BLANK = r"[\s\x{FEFF}]"
#: The same as characters.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(text: Column | str) -> Column:
    """Without white space of any kind at both ends; only the ends are looked at, whatever runs of blanks the text holds."""
    return F.trim(_col(text), F.lit(_BLANKS))


def clean(text: Column | str) -> Column:
    """Line ends as LF, runs of blanks and tabs as one blank, three or more LFs as two, then each line trimmed."""
    out = F.replace(_col(text), F.lit("\r\n"), F.lit("\n"))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(out, "\n", -1), trim_all), "\n")


def word_count(text: Column | str) -> Column:
    trimmed = trim_all(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, rf"(?U){_BLANK}+", -1))).cast("bigint")


def char_count(text: Column | str) -> Column:
    """Code points."""
    return F.length(_col(text)).cast("bigint")


def utf16_count(text: Column | str) -> Column:
    """UTF-16 code units, for callers that count characters so."""
    return (F.length(F.encode(_col(text), "UTF-16BE")) / 2).cast("bigint")


def line_count(text: Column | str) -> Column:
    return F.size(F.split(_col(text), "\n", -1)).cast("bigint")


def _share_without(text: Column, plain: str, others: str) -> Column:
    """Share of characters that aren't in a class, which is given by its ASCII characters and a pattern; null for an empty text.

    The ASCII ones go first, without a match for each run of them. The result stands in no
    branch, so that Spark computes it once for all that use it in a row.
    """
    size = F.length(text)
    left = F.length(F.regexp_replace(F.translate(text, plain, ""), f"{others}++", ""))
    return left / F.when(size > 0, size)


def special_ratio(text: Column | str) -> Column:
    """Share of characters that are neither ASCII word characters, white space nor CJK; 0 for an empty text."""
    text = _col(text)
    share = _share_without(text, ascii_letters + digits + whitespace + "_", r"[\w\s\x{4E00}-\x{9FA5}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]")
    return F.coalesce(share, F.when(F.length(text) == 0, 0.0))


def looks_scanned(text: Column | str, pages: Column | str) -> Column:
    """Whether a PDF's extracted text suggests that its pages are images."""
    text, pages = _col(text), _col(pages)
    trimmed = trim_all(text)
    size = F.length(trimmed)
    average = F.when(size > 0, size / pages)
    special = special_ratio(trimmed)
    unreadable = _share_without(trimmed, ascii_letters + digits, r"[\x{4E00}-\x{9FA5}]")
    return (size == 0) | (average < 100) | (special > 0.3) | (unreadable > 0.5) | ((average < 200) & (special > 0.2))


def pdf_info(text: Column | str, pages: Column | str) -> Column:
    """What is known of a PDF from its text: pages, length, characters a page, special characters, whether it looks scanned."""
    text, pages = _col(text), _col(pages)
    length = F.length(text).cast("bigint")
    return F.struct(pages.cast("bigint").alias("num_pages"), length.alias("text_length"), (length / pages).alias("avg_chars_per_page"), special_ratio(text).alias("special_char_ratio"), looks_scanned(text, pages).alias("is_scanned"))


def format_size(size: Column | str) -> Column:
    """Bytes with two decimals and a unit from B to GB."""
    size = _col(size).cast("double")
    out = F.format_string("%.2f GB", size / 1024**3)
    for power, unit in ((2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size / 1024**power < 1024, F.format_string(f"%.2f {unit}", size / 1024**power)).otherwise(out)
    return out


def content_hash(content: Column | str) -> Column:
    """The first 16 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(_col(content), 256), 1, 16)


def cache_key(filename: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("buffer:"), _col(filename), F.lit(":"), content_hash(content))


def decode_bytes(content: Column | str) -> Column:
    """UTF-8 text of bytes, invalid sequences as U+FFFD."""
    return F.make_valid_utf8(_col(content).cast("string"))


def detect_encoding(content: Column | str) -> Column:
    """The encoding a byte order mark tells, ``utf-8`` if the bytes are valid, else null."""
    content = _col(content)
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", "utf-8")
        .when(head.startswith("FFFE"), "utf-16le")
        .when(head.startswith("FEFF"), "utf-16be")
        .when(F.is_valid_utf8(content.cast("string")) & ~content.cast("string").contains("�"), "utf-8")
    )


def normalize_encoding(name: Column | str) -> Column:
    """The decoder for an encoding's name; unknown names are read as utf-8."""
    low = F.lower(_col(name))
    known = {"utf-8": "utf-8", "utf8": "utf-8", "ascii": "ascii", "us-ascii": "ascii", "utf-16le": "utf-16le", "utf-16be": "utf-16be", "iso-8859-1": "latin1", "latin1": "latin1", "windows-1252": "latin1"}
    out = F.lit("utf-8")
    for key, value in known.items():
        out = F.when(low == key, value).otherwise(out)
    return out


def decode_as(content: Column | str, encoding: Column | str) -> Column:
    """Text of bytes in one of the encodings that normalize_encoding() gives; an odd last byte of UTF-16 is no unit and is left out."""
    content, name = _col(content), normalize_encoding(encoding)
    even = F.substring(content, F.lit(1), (F.length(content) - F.length(content) % 2).cast("int"))
    return (
        F.when(name == "utf-16le", F.decode(even, "UTF-16LE"))
        .when(name == "utf-16be", F.decode(even, "UTF-16BE"))
        .when(name == "latin1", F.decode(content, "ISO-8859-1"))
        .otherwise(decode_bytes(content))
    )


# HTML ---------------------------------------------------------------------

#: The entities that are decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))


def drop_scripts(html: Column | str) -> Column:
    """HTML without script and style elements; the lazy form can't overflow the stack."""
    return F.regexp_replace(F.regexp_replace(_col(html), r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", "")


def decode_entities(text: Column | str) -> Column:
    """Named entities, in a fixed order, then numeric references of one character each.

    As ``&amp;`` is decoded before numeric references, ``&amp;#65;`` becomes ``A``.
    """
    out = _col(text)
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.when(out.contains("&#"), _numeric_references(out)).otherwise(out)


def _numeric_references(text: Column) -> Column:
    pieces = F.split(text, r"(?=&#(?:[0-9]+|[xX][0-9a-fA-F]+);)", -1)

    def decoded(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"\A&#([0-9]+);", 1)
        hexed = F.regexp_extract(piece, r"\A&#[xX]([0-9a-fA-F]+);", 1)
        code = F.when(decimal != "", F.conv(decimal, 10, 10)).when(hexed != "", F.conv(hexed, 16, 10)).cast("bigint") % 65536
        character = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        return F.when(code.isNotNull(), F.concat(F.when((code >= 0xD800) & (code <= 0xDFFF), "�").otherwise(character), F.regexp_replace(piece, r"\A&#[0-9a-zA-Z]+;", ""))).otherwise(piece)

    return F.array_join(F.transform(pieces, decoded), "")


def strip_tags(html: Column | str) -> Column:
    """Tags as blanks, entities decoded, runs of white space as one blank, trimmed."""
    return trim_all(F.regexp_replace(decode_entities(F.regexp_replace(_col(html), r"<[^>]+>", " ")), rf"(?U){_BLANK}+", " "))


def strip_html(html: Column | str) -> Column:
    """The text of an HTML page."""
    return strip_tags(drop_scripts(html))
