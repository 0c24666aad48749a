"""Bit fields of a payload, computed inside the JVM without UDFs.

A payload is an array of 64-bit words: first the words read most significant
byte first, then the same words with their bytes swapped. A Motorola field lies
in the first half, an Intel field in the second, and both are cut the same way:
shift the word that holds the lowest bit, fill up from the neighbouring word,
mask. Where a field lies is worked out once per catalog row (place_of).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_64 = "18446744073709551616"


def _shl(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int"))


def _shr(a: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", a, n.cast("int"))


def byte_swapped(word: Column) -> Column:
    """The eight bytes of a 64-bit word in reverse order."""
    m1, m2 = F.lit(0x00FF00FF00FF00FF), F.lit(0x0000FFFF0000FFFF)
    one = _shl(word.bitwiseAND(m1), F.lit(8)).bitwiseOR(_shr(word, F.lit(8)).bitwiseAND(m1))
    two = _shl(one.bitwiseAND(m2), F.lit(16)).bitwiseOR(_shr(one, F.lit(16)).bitwiseAND(m2))
    return _shl(two, F.lit(32)).bitwiseOR(_shr(two, F.lit(32)))


def big_endian_words(payload: Column) -> Column:
    """ARRAY<BIGINT>: the payload, zero padded at its end, most significant byte first."""
    digits = F.hex(payload)

    def half(i, at):
        part = F.rpad(F.substr(digits, i * 16 + at, F.lit(8)), 8, "0")
        return F.conv(part, 16, 10).cast("bigint")

    last = F.greatest(F.ceil(F.octet_length(payload) / 8).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: _shl(half(i, 1), F.lit(32)).bitwiseOR(half(i, 9)))


def with_words(rows, payload: Column):
    """Add words: both readings of the payload, one after the other."""
    rows = rows.withColumn("words", big_endian_words(payload))
    return rows.withColumn("words", F.concat("words", F.transform("words", byte_swapped)))


def place_of(start_bit: Column, length: Column, little_endian: Column, msb_pos: Column, dlc: Column) -> dict[str, Column]:
    """Catalog columns of a field: word of its lowest bit, step to the next higher word, shift, and mask."""
    half = F.ceil(dlc / 8).cast("int")
    last = msb_pos + length - 1
    return {
        "at": F.when(little_endian, half + F.floor(start_bit / 64).cast("int")).otherwise(F.floor(last / 64).cast("int")),
        "dir": F.when(little_endian, 1).otherwise(-1),
        "off": F.when(little_endian, start_bit % 64).otherwise(63 - last % 64),
        "mask": low_mask(length),
    }


def low_mask(bits: Column) -> Column:
    ones = F.lit(-1).cast("bigint")
    return F.when(bits >= 64, ones).otherwise(F.bitwise_not(_shl(ones, bits)))


def _cut(words: Column, at: Column, sig: Column) -> Column:
    """64 bits from the field's shift on, starting in word `at`."""
    low = _shr(F.get(words, at), sig["off"])
    fill = F.when(sig["off"] > 0, _shl(F.coalesce(F.get(words, at + sig["dir"]), F.lit(0).cast("bigint")), 64 - sig["off"]))
    return low.bitwiseOR(F.coalesce(fill, F.lit(0).cast("bigint")))


def raw_low64(words: Column, sig: Column) -> Column:
    """The low 64 bits of the raw value as a BIGINT bit pattern."""
    return _cut(words, sig["at"], sig).bitwiseAND(sig["mask"])


def raw_pieces(words: Column, sig: Column) -> Column:
    """Raw value of a field wider than 64 bits: 64-bit pieces, least significant first."""
    count = F.ceil(sig["length"] / 64).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: _cut(words, sig["at"] + sig["dir"] * i, sig).bitwiseAND(
        low_mask(sig["length"] - i * 64)))


def as_unsigned(word: Column) -> Column:
    """DECIMAL(20,0) reading of a 64-bit pattern."""
    wide = word.cast("decimal(20,0)")
    return F.when(word < 0, (wide + F.lit(TWO_64).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def hex_text(word: Column, pieces: Column | None = None) -> Column:
    """0x... without leading zeros. pieces is NULL for fields of up to 64 bits."""
    narrow = F.concat(F.lit("0x"), F.hex(word))
    if pieces is None:
        return narrow
    digits = F.aggregate(pieces, F.lit(""), lambda acc, p: F.concat(F.lpad(F.hex(p), 16, "0"), acc))
    return F.when(pieces.isNull(), narrow).otherwise(F.concat(F.lit("0x"), F.regexp_replace(digits, "^0+(?=.)", "")))


def _joined(top: Column, low: Column) -> Column:
    """top * 2**64 + low as DECIMAL(38,0); NULL if that is too wide."""
    high = F.try_multiply(top.cast("decimal(20,0)"), F.lit(TWO_64).cast("decimal(20,0)"))
    return F.try_add(high, as_unsigned(low)).try_cast("decimal(38,0)")


def exact_raw(word: Column, pieces: Column | None = None) -> Column:
    """DECIMAL(38,0) up to 126 bits, NULL above (raw_hex keeps those)."""
    narrow = as_unsigned(word).cast("decimal(38,0)")
    if pieces is None:
        return narrow
    wide = F.when(F.size(pieces) == 2, _joined(as_unsigned(F.get(pieces, F.lit(1))), F.get(pieces, F.lit(0))))
    return F.when(pieces.isNull(), narrow).otherwise(wide)


def _ieee(bits: Column, exp_bits: int, frac_bits: int) -> Column:
    """Value of an IEEE 754 bit pattern; Spark has no bit-cast."""
    bias = (1 << (exp_bits - 1)) - 1
    top = (1 << exp_bits) - 1
    frac = bits.bitwiseAND(F.lit((1 << frac_bits) - 1)).cast("double")
    exp = F.shiftrightunsigned(bits, frac_bits).bitwiseAND(F.lit(top))
    negative = F.shiftrightunsigned(bits, frac_bits + exp_bits).bitwiseAND(F.lit(1)) == 1
    scaled = frac / float(1 << frac_bits)
    # Subnormal numbers share the smallest exponent and have no leading one.
    e = (F.greatest(exp, F.lit(1)) - bias).cast("double")
    lead = F.when(exp == 0, 0.0).otherwise(1.0)
    # Two factors keep the power finite at both ends of the exponent range.
    half = F.floor(e / 2)
    value = (scaled + lead) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)
    size = F.when(exp < top, value).when(frac == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(negative, -size).otherwise(size)


def _wide_value(word: Column, pieces: Column, sig: Column) -> Column:
    """Integer reading of a field of more than 64 bits."""
    top = F.element_at(pieces, -1)
    pad = 63 - (sig["length"] - 1) % 64
    signed_top = F.call_function("shiftright", _shl(top, pad), pad.cast("int"))
    exact = F.when(F.size(pieces) == 2, F.when(
        sig["is_signed"], _joined(signed_top, F.get(pieces, F.lit(0)))).otherwise(exact_raw(word, pieces))).cast("double")
    start = F.when(sig["is_signed"], signed_top.cast("double")).otherwise(as_unsigned(top).cast("double"))
    lower = F.reverse(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
    rough = F.aggregate(lower, start, lambda acc, p: acc * 1.8446744073709552e19 + as_unsigned(p).cast("double"))
    return F.coalesce(exact, rough)


def physical_value(word: Column, pieces: Column | None, sig: Column, *, ieee: bool = True) -> Column:
    """Signed, unsigned or IEEE reading times scale plus offset.

    pieces and ieee are given only for a catalog that has such fields; without
    them the expression stays short.
    """
    n = sig["length"]
    sign_extended = F.call_function("shiftright", _shl(word, 64 - n), (64 - n).cast("int"))
    reading = F.when(sig["is_signed"], sign_extended.cast("double")).when(
        word >= 0, word.cast("double")).otherwise(as_unsigned(word).cast("double"))
    if pieces is not None:
        reading = F.when(pieces.isNull(), reading).otherwise(_wide_value(word, pieces, sig))
    if ieee:
        kind, nan = sig["value_kind"], F.lit(float("nan"))
        reading = (F.when(kind == "IeeeFloat32", F.when(n == 32, _ieee(word, 8, 23)).otherwise(nan))
                   .when(kind == "IeeeFloat64", F.when(n == 64, _ieee(word, 11, 52)).otherwise(nan)).otherwise(reading))
    return reading * sig["scale"] + sig["offset"]
