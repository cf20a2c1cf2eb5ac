"""Column functions: strict parsing, hex and bit arithmetic, hashes, one-hot vectors, CASE rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL_INT = "^(0|-?[1-9][0-9]*)$"


def strict_int(text: Column) -> Column:
    """The integer a text spells canonically (no sign of plus, no leading zeros); an error for any other text."""
    ok = text.rlike(CANONICAL_INT)
    return F.when(ok | text.isNull(), text.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a canonical integer: "), text)).cast("long"))


def is_canonical_int(text: Column) -> Column:
    return F.coalesce(text.rlike(CANONICAL_INT), F.lit(False))


def strict_bit(text: Column) -> Column:
    """0 or 1 from '0', '1', 'true' or 'false'; an error for any other text."""
    return F.when(text.isin("0", "false"), F.lit(0)).when(text.isin("1", "true"), F.lit(1)).otherwise(F.when(text.isNull(), F.lit(None).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a bit: "), text)).cast("int")))


def plain_hex(text: Column, digits: int = 64) -> Column:
    """Lower-case hex without 0x, padded with zeros on the left."""
    return F.lpad(F.regexp_replace(F.lower(F.trim(text)), "^0x", ""), digits, "0")


def zero_padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def site_name(index: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), zero_padded(index, 6))


def binary_text(number: Column, width: int) -> Column:
    return F.lpad(F.bin(number), width, "0")


def bare_bus(name: Column) -> Column:
    """A net's name without its bus index."""
    return F.regexp_replace(name, r"\[[0-9]+\]$", "")


def hamming(left: Column, right: Column, digits: int = 64) -> Column:
    """Differing bits of two hex strings, taken in chunks of eight digits."""
    total = F.lit(0)
    for k in range(0, digits, 8):
        chunk = [F.conv(F.substring(x, k + 1, 8), 16, 10).cast("long") for x in (left, right)]
        total = total + F.bit_count(chunk[0].bitwiseXOR(chunk[1]))
    return total.cast("int")


def bits_of(hex_text: Column, digits: int) -> Column:
    """Bits of a hex string, most significant first, as an array of bytes (0 or 1)."""
    nibbles = F.transform(F.sequence(F.lit(1), F.lit(digits)), lambda i: F.lpad(F.bin(F.conv(F.substr(hex_text, i, F.lit(1)), 16, 10).cast("long")), 4, "0"))
    joined = F.array_join(nibbles, "")
    return F.transform(F.sequence(F.lit(1), F.lit(digits * 4)), lambda i: F.substr(joined, i, F.lit(1)).cast("tinyint"))


def packed(bits: Column) -> Column:
    """The hex string whose bits these are: the inverse of bits_of."""
    text = F.array_join(F.transform(bits, lambda b: b.cast("string")), "")
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(bits) / 4 - 1).cast("int")), lambda i: F.lower(F.conv(F.substr(text, i * 4 + 1, F.lit(4)), 2, 16))), "")


def coverage_mask(slot: Column) -> Column:
    """Aggregate: a bit for each slot seen (slots 0 to 62)."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.cast("int")))


def hmac_sha256(key_hex: Column, message_hex: Column) -> Column:
    """HMAC-SHA256 of hex text under a key of 32 bytes, as lower-case hex."""

    def pad(byte: str) -> Column:
        masked = [F.lpad(F.lower(F.hex(F.conv(F.substring(key_hex, k + 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(int(byte * 4, 16))))), 8, "0") for k in range(0, 64, 8)]
        return F.concat(*masked, F.lit(byte * 32))

    inner = F.sha2(F.unhex(F.concat(pad("36"), message_hex)), 256)
    return F.sha2(F.unhex(F.concat(pad("5c"), inner)), 256)


def observation_bytes(timed_out: Column, cycles: Column, digest: Column) -> Column:
    """A response as hex: timeout byte, two bytes of cycles, 32 bytes of digest (zeros at a timeout)."""
    seen = F.when(timed_out == 1, F.lit("0" * 64)).otherwise(digest)
    return F.concat(F.lpad(F.hex(timed_out.cast("long")), 2, "0"), F.lpad(F.hex(cycles.cast("long")), 4, "0"), F.upper(seen))


def one_hot(value: Column, vocabulary: Sequence[str]) -> Column:
    return F.array(*[F.coalesce((value == F.lit(v)).cast("float"), F.lit(0.0).cast("float")) for v in vocabulary])


def sums_to_one(vector: Column) -> Column:
    return F.abs(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double")) - 1) < 1e-9


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient, 0 where the denominator is 0."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def null_ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient, null where the denominator is 0."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def edge_role(cell_type: Column, port: Column) -> Column:
    """What a branch does at its sink; the first rule that fits counts."""
    name, kind = F.upper(F.ltrim(port, F.lit("\\"))), F.upper(cell_type)
    # fixed values: port names of each role
    return (
        F.when(name.isin("C", "CLK", "CLOCK"), "CLOCK")
        .when(name.isin("R", "RN", "RESET", "RST", "CLR", "ARST", "SRST"), "RESET")
        .when(name.isin("E", "EN", "ENABLE", "CE"), "ENABLE")
        .when(name.isin("S", "SEL", "SELECT") | (kind.contains("MUX") & name.startswith("S")), "SELECT")
        .when(name.isin("D", "I", "IN", "DATA") | name.startswith("A") | name.startswith("B"), "DATA")
        .otherwise("OTHER")
    )


def bit_kind(raw: Column) -> Column:
    """'wire' for a number, 'constant' for 0, 1, x or z in quotes, an error for all else (true and false too)."""
    return F.when(raw.rlike("^[0-9]+$"), "wire").when(raw.isin('"0"', '"1"', '"x"', '"z"'), "constant").otherwise(F.raise_error(F.concat(F.lit("unsupported bit: "), F.coalesce(raw, F.lit("null")))).cast("string"))


def instance_class(detected: Column, activated: Column) -> Column:
    return F.when(detected > 0, "DETECTED").when(activated > 0, "ACTIVATED_UNOBSERVED").otherwise("UNACTIVATED")
