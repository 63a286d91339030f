"""Text expressions: lengths in UTF-16 units, trimming of control characters, lists in text, templates, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, as lengths are counted throughout."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def trim_control(c: Column) -> Column:
    """Strips characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column) -> Column:
    return ~text_or_empty(c).rlike(r"[^\s\p{Z}]") | (text_or_empty(c) == "")


def contains_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def split_list(value: str | None, separators: str = ",") -> list[str]:
    """A delimited list of configuration: trimmed, lower-cased, without empty parts."""
    return [w for w in (p.strip().lower() for p in re.split(f"[{separators}]", value or "")) if w]


def split_column(c: Column, separators: str = ",") -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), f"[{separators}]"), lambda p: trim_control(p)), lambda p: p != "")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def three_decimals(c: Column) -> Column:
    return F.format_string("%.3f", c)


def units(c: Column) -> Column:
    """UTF-16 code units, two bytes each."""
    return F.encode(c, "UTF-16BE")


def unit_slice(c: Column, start: Column | int, n: Column | int) -> Column:
    """n of some units from ``start`` (0: the first)."""
    whole = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.substring(c, whole(start) * 2 + 1, F.greatest(F.lit(0), whole(n) * 2))


def _is_half(byte: Column, first: str) -> Column:
    """Whether a unit's first byte is that of a high (D8) or low (DC) surrogate."""
    return F.hex(byte).between(first, "DB" if first == "D8" else "DF")


def unit_text(c: Column) -> Column:
    """Text of some units; a half of a pair at either end becomes a question mark, as encoders have it."""
    n = F.octet_length(c)
    mark = F.lit(bytearray(b"\x00?"))
    c = F.when((n > 0) & _is_half(F.substring(c, F.lit(1), F.lit(1)), "DC"), F.concat(mark, F.substring(c, F.lit(3), n))).otherwise(c)
    c = F.when((n > 0) & _is_half(F.substring(c, n - 1, F.lit(1)), "D8"), F.concat(F.substring(c, F.lit(1), n - 2), mark)).otherwise(c)
    return F.decode(c, "UTF-16BE")


def truncate(c: Column, n: int) -> Column:
    """Cut to n UTF-16 units and dotted, if longer; null stays null."""
    short = F.when(F.octet_length(c) == F.length(c), F.substring(c, 1, n)).otherwise(unit_text(unit_slice(units(c), 0, n)))
    return F.when(utf16_length(c) > n, F.concat(short, F.lit("..."))).otherwise(c)


def is_placeholder_name(c: Column) -> Column:
    return c.isNull() | is_blank(c) | (c == "Unknown") | c.startswith("User ")


def has_link(c: Column) -> Column:
    return contains_any(text_or_empty(c), ["](", "http://", "https://"])


def sender_or_unknown(c: Column) -> Column:
    return F.when(c.isNull() | is_blank(c), F.lit("Unknown")).otherwise(c)


def source_type(title: Column, chat_id: Column) -> Column:
    return F.when(text_or_empty(title).startswith("Direct: ") | (chat_id > 0), F.lit("DIRECT_CHAT")).otherwise(F.lit("GROUP"))


def is_general_topic(topic_id: Column, name: Column) -> Column:
    return (F.coalesce(topic_id, F.lit(-1)) == 1) | F.lower(text_or_empty(name)).isin("general", "общий")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced where the name is known, kept where it is not."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def fenced_json(c: Column, braces: bool = False) -> Column:
    """The body of a ```json block, else of a ``` block, else (braces) from the first { to the last }, else everything."""
    json_block = F.regexp_extract(c, r"(?s)```json(.+?)```", 1)
    plain_block = F.regexp_extract(c, r"(?s)```(.+?)```", 1)
    out = F.when(json_block != "", trim_control(json_block)).when(~c.contains("```json") & (plain_block != ""), trim_control(plain_block))
    if braces:
        body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
        out = out.when(body != "", body)
    return out.otherwise(c)


def message_title(c: Column) -> Column:
    """The first ``# `` line, else the first line with text, cut to 100 characters."""
    lines = F.transform(F.split(c, "\n"), lambda x: trim_control(x))
    heading = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    first = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    return F.coalesce(trim_control(F.substring(heading, 3, 1 << 30)), F.substring(first, 1, 100), F.lit("Untitled Guide"))


def key_values(c: Column) -> Column:
    """``a=b | c`` to a map; a part without a sign has an empty value."""
    parts = F.filter(F.transform(F.split(text_or_empty(c), r"\|"), lambda p: trim_control(p)), lambda p: p != "")
    pair = lambda p: F.struct(trim_control(F.substring_index(p, "=", 1)), F.when(p.contains("="), trim_control(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit("")))
    return F.map_from_entries(F.transform(parts, pair))


def links(c: Column) -> Column:
    """Markdown links and bare addresses, in order."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"(\[[^\]]+\]\(https?://[^)\s]+\)|https?://[^\s)]+)"), F.lit(1))


def message_url(username: Column, chat_id: Column, message_id: Column) -> Column:
    """A public group's address by its name, a private one's by its number without -100."""
    private = F.regexp_replace(chat_id.cast("string"), "^-100", "")
    return F.when(text_or_empty(username) != "", F.concat(F.lit("https://t.me/"), F.regexp_replace(username, "^@", ""), F.lit("/"), message_id.cast("string"))).when(
        chat_id.cast("string").startswith("-100"), F.concat(F.lit("https://t.me/c/"), private, F.lit("/"), message_id.cast("string"))
    )


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def json_escape(c: Column) -> Column:
    """A text as it stands between the quotes of a JSON string; null is empty."""
    quoted = F.to_json(F.struct(text_or_empty(c).alias("t")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def normalised_username(c: Column) -> Column:
    return trim_control(text_or_empty(c))


def short_cost(c: Column) -> Column:
    return F.format_string("$%.4f", c)


def short_number(c: Column) -> Column:
    return (
        F.when(c >= 1_000_000, F.concat(F.format_string("%.1f", c / 1_000_000.0), F.lit("M")))
        .when(c >= 1000, F.concat(F.format_string("%.1f", c / 1000.0), F.lit("K"))).otherwise(c.cast("string"))
    )


def short_duration(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit(" s"))).otherwise(F.concat(ms.cast("string"), F.lit(" ms")))


def spliced_links(text: Column, entities: Column) -> Column:
    """Text with each entity (offset, length, url) as a markdown link, from the last to the first; ranges are clamped.

    Offsets and lengths count UTF-16 units. An offset or end within a pair counts as the pair's begin.
    """

    def whole(acc: Column, at: Column) -> Column:
        """``at``, or the unit before it if it stands between the halves of a pair."""
        return F.when(_is_half(unit_slice(acc, at, 1).substr(F.lit(1), F.lit(1)), "DC"), at - 1).otherwise(at)

    def splice(acc: Column, e: Column) -> Column:
        size = (F.octet_length(acc) / 2).cast("int")
        start = whole(acc, F.greatest(F.lit(0), F.least(e["offset"], size)))
        end = whole(acc, F.greatest(start, F.least(e["offset"] + e["length"], size)))
        label = unit_slice(acc, start, end - start)
        linked = F.concat(unit_slice(acc, 0, start), units(F.lit("[")), label, units(F.lit("](")), units(e["url"]), units(F.lit(")")), unit_slice(acc, end, size))
        return F.when((F.octet_length(label) == 0) | (label == units(e["url"])), acc).otherwise(linked)

    last_first = F.reverse(F.array_sort(F.transform(entities, lambda e: F.struct(e["offset"].cast("int").alias("offset"), e["length"].cast("int").alias("length"), e["url"].alias("url")))))
    return F.decode(F.aggregate(last_first, units(text_or_empty(text)), splice), "UTF-16BE")


def is_valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM accepts a configured pattern; tested once on the driver, so that a bad one fails no task."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return bool(pattern.strip())
    except Exception:
        return False
