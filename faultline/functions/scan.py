"""Decoding of raw adapter responses with native bit and string functions."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv

PAIR = "(?s)(.{4})"


def pair_value(pair):
    """Four hex digits as a number; anything else is null."""
    return F.when(pair.rlike("^[0-9A-Fa-f]{4}$"), F.conv(pair, 16, 10).try_cast("int"))


def code_of(value):
    """A 16-bit value as a trouble code; an empty slot (0) is null."""
    system = F.shiftright(value, 14).cast("int") + 1
    first_digit = F.shiftright(value, 12).bitwiseAND(F.lit(3)).cast("string")
    rest = F.lpad(F.hex(value.bitwiseAND(F.lit(0x0FFF))), 3, "0")
    return F.when(
        value != 0,
        F.concat(F.substring(F.lit(fv.CODE_LETTERS), system, F.lit(1)), first_digit, rest),
    )


def decode_code(high, low):
    """Two bytes as hex text to a trouble code; an empty slot or bad hex is null."""
    return code_of(pair_value(F.concat(high, low)))


def clean_lines(raw):
    """Response lines without prompt, blanks, echoes and acknowledgements."""
    dropped = ">" + fv.WHITESPACE_CHARACTERS.replace("\r", "").replace("\n", "")
    # Carriage returns become line ends; characters without a partner disappear.
    bare = F.upper(F.translate(raw, "\r" + dropped, "\n"))
    return F.filter(
        F.split(bare, "\n"),
        lambda line: (line != "") & (line != "OK") & ~line.startswith("AT"),
    )


def scan_error(joined):
    """Error class of the joined lines, tested in a fixed order; null is no error."""

    return (
        F.when(has_no_data(joined), None)
        .when(joined.contains("UNABLE") | joined.contains("NOCONN"), "no_connection")
        .when(joined.contains("ERROR"), "can_error")
        .when(joined.contains("BUSBUSY"), "bus_busy")
        .when(joined.contains("STOPPED"), "stopped")
    )


def has_no_data(joined):
    return joined.contains("NODATA")


def scan_codes(lines, mode):
    """Distinct codes of the data lines, in order of first occurrence."""
    prefix = F.when(mode == "07", fv.REPLY_PREFIX["07"]).otherwise(fv.REPLY_PREFIX["03"])
    replies = F.filter(lines, lambda line: line.startswith(prefix))
    pairs = F.transform(
        replies,
        lambda line: F.regexp_extract_all(F.substring(line, 5, 1 << 30), F.lit(PAIR), F.lit(1)),
    )
    values = F.transform(F.flatten(pairs), pair_value)
    return F.array_distinct(F.array_compact(F.transform(values, code_of)))


def scan_error_text(error):
    chain = None
    for code, text in fv.SCAN_ERROR_TEXT.items():
        chain = F.when(error == code, text) if chain is None else chain.when(error == code, text)
    return chain


def is_adapter(raw):
    return raw.rlike(fv.ADAPTER_PATTERN)
