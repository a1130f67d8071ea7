"""Check digits, payment lines, payment payloads and encodings as column expressions.

All functions return null for null input; nothing raises on malformed text.
"""

from __future__ import annotations

import binascii
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacre.functions.once import step


def digits(c: Column) -> Column:
    """ASCII digits of a text."""
    return F.regexp_replace(c, "[^0-9]", "")


def _check_digits(texts: pa.Array, weights: tuple[int, ...], made: Callable) -> pa.Array:
    """made(sums of the weighted digits of each text, from the right; without weights each second digit counts as the digit
    sum of its double), null where a text is empty or has anything but digits; a whole batch at once."""
    import numpy as np

    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode(), np.uint8)
    sizes = np.diff(ends, prepend=0)
    right = np.repeat(ends, sizes) - 1 - np.arange(len(data))
    value = data.astype(np.int64) - 48
    bad = (value < 0) | (value > 9)
    product = value * np.array(weights)[right % len(weights)] if weights else np.where(right % 2 == 0, value * 2 - 9 * (value > 4), value)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
    return pa.array(made(total(product)).astype(np.int32), mask=(sizes == 0) | (total(bad) > 0))


def modulo_10(c: Column) -> Column:
    """Check digit of a text of digits: weights 2, 1 from the right, the products' digits summed."""

    @F.arrow_udf("int")
    def digit(texts: pa.Array) -> pa.Array:
        return _check_digits(texts, (), lambda n: (10 - n % 10) % 10)

    return digit(c)


def modulo_10_of(n: Column, width: int) -> Column:
    """modulo_10 of a number's digits, without a detour over texts."""
    digit = lambda i: F.call_function("div", n, F.lit(10**i)) % 10
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = sum((twice(digit(i)) if i % 2 == 0 else digit(i) for i in range(width)), F.lit(0))
    return ((10 - total % 10) % 10).cast("int")


def modulo_11(c: Column) -> Column:
    """Check digit of a text of digits: weights 2 to 9 from the right; remainders 0 and 1 give 0, 10 gives 1."""

    @F.arrow_udf("int")
    def digit(texts: pa.Array) -> pa.Array:
        import numpy as np

        return _check_digits(texts, tuple(range(2, 10)), lambda n: np.array([0, 0, 9, 8, 7, 6, 5, 4, 3, 2, 1])[n % 11])

    return digit(c)


def payment_line_kind(line: Column) -> Column:
    """BANK_SLIP (47 digits), COLLECTION (48 that start with 8) or UNKNOWN."""
    return F.when(F.length(line) == 47, "BANK_SLIP").when((F.length(line) == 48) & line.startswith("8"), "COLLECTION").otherwise("UNKNOWN")


def _part(line: Column, a: int, n: int) -> Column:
    return F.substring(line, a + 1, n)


def _all_match(line: str, doubled: str, fields: tuple[tuple[int, int], ...], rule: int) -> Column:
    """Whether each field (start, length) is followed by its check digit, by modulo 10 or 11.

    The sums are written out as SQL, so they are generated code; doubled is the line with every digit replaced by the
    digit sum of its double, made once for all fields.
    """

    def digit(column: str, place: int) -> str:
        return f"(ascii(substring({column}, {place}, 1)) - 48)"

    tests = []
    for start, n in fields:
        if rule == 10:
            total = " + ".join(digit(doubled if i % 2 == 0 else line, start + n - i) for i in range(n))
            check = f"(10 - ({total}) % 10) % 10"
        else:
            total = " + ".join(f"{digit(line, start + n - i)} * {i % 8 + 2}" for i in range(n))
            check = f"element_at(array(0, 0, 9, 8, 7, 6, 5, 4, 3, 2, 1), ({total}) % 11 + 1)"
        tests.append(f"{check} = {digit(line, start + n + 1)}")
    return F.expr(" and ".join(tests))


SLIP_FIELDS = ((0, 9), (10, 10), (21, 10))
COLLECTION_FIELDS = tuple((12 * k, 11) for k in range(4))


def validated_lines(df: DataFrame, line: str) -> DataFrame:
    """Adds kind, status (VALID, INVALID, INCONCLUSIVE where no rule is known) and barcode (44 digits, valid lines only)."""
    c = F.col(line)
    df = step(df, kind=payment_line_kind(c), _doubled=F.translate(c, "0123456789", "0246813579"))
    reference = _part(c, 2, 1)
    valid = (
        F.when(F.col("kind") == "BANK_SLIP", _all_match(line, "_doubled", SLIP_FIELDS, 10))
        .when((F.col("kind") == "COLLECTION") & reference.isin("6", "7"), _all_match(line, "_doubled", COLLECTION_FIELDS, 10))
        .when((F.col("kind") == "COLLECTION") & reference.isin("8", "9"), _all_match(line, "_doubled", COLLECTION_FIELDS, 11))
    )
    df = step(df, _valid=valid)
    df = df.withColumn("status", F.when(F.col("_valid"), "VALID").when(~F.col("_valid"), "INVALID").otherwise("INCONCLUSIVE")).drop("_valid", "_doubled")
    slip = F.concat(_part(c, 0, 4), _part(c, 32, 15), _part(c, 4, 5), _part(c, 10, 10), _part(c, 21, 10))
    collection = F.concat(*(_part(c, a, n) for a, n in COLLECTION_FIELDS))
    return df.withColumn("barcode", F.when(F.col("status") == "VALID", F.when(F.col("kind") == "BANK_SLIP", slip).otherwise(collection)))


def collection_amount(barcode: Column) -> Column:
    """Amount of a collection bar code: 44 digits from 8 on, a valid general check digit, and a value in money."""
    c = digits(barcode)
    rest = F.concat(F.substring(c, 1, 3), F.substring(c, 5, 40))
    mark, check = F.substring(c, 3, 1), F.substring(c, 4, 1).cast("int")
    expected = F.when(mark.isin("6", "7"), modulo_10(rest)).when(mark.isin("8", "9"), modulo_11(rest))
    good = (F.length(c) == 44) & c.startswith("8") & F.substring(c, 2, 1).isin(*"12345679") & mark.isin("6", "8") & (expected == check)
    return F.when(good, F.substring(c, 5, 11).cast("decimal(18,2)") / F.lit(100)).cast("decimal(18,2)")


def money(c: Column) -> Column:
    """1.234,56 as a decimal; null for other notations."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".")
    return F.when(F.trim(c).rlike(r"^(?:\d{1,3}(?:\.\d{3})+|\d+),\d{2}$"), plain.try_cast("decimal(18,2)"))


def _crc16(text: str) -> str:
    data = text.encode() if text.isascii() else bytes(ord(x) & 0xFF for x in text if x != "\0")
    return f"{binascii.crc_hqx(data.replace(b'\0', b'') if text.isascii() else data, 0xFFFF):04X}"


def crc16(c: Column) -> Column:
    """CRC16-CCITT (start FFFF, polynomial 1021) of an ASCII text, as four hex digits."""

    @F.arrow_udf("string")
    def folded(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _crc16(t) for t in texts.to_pylist()], pa.string())

    return folded(c)


def _tlv(text: str | None, depth: int) -> dict[str, str] | None:
    """See tlv()."""
    if not text:
        return None
    out: dict[str, str] = {}
    at = 0
    for _ in range(depth):
        head = text[at : at + 4]
        if len(head) < 4 or not (head.isascii() and head.isdigit()):
            return None
        end = at + 4 + int(head[2:])
        if end > len(text) or head[:2] in out:
            return None
        out[head[:2]] = text[at + 4 : end]
        at = end
        if at == len(text):
            return out
    return None


def payload_parts(c: Column, depth: int = 40) -> Column:
    """A payload's (ours, place, stated, sum) in one pass: whether it has format 01 and names the instant-payment scheme in a
    merchant field (26 to 51), its currency and country, its amount, and the check sum of what stands before the last field's
    four digits; null for null."""

    @F.arrow_udf("ours boolean, place string, stated string, sum string")
    def parts(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            f = _tlv(t, depth) or {}
            named = any("26" <= k <= "51" and ((_tlv(v, depth) or {}).get("00") or "").lower() == "br.gov.bcb.pix" for k, v in f.items())
            ours = f.get("00") == "01" and named
            sealed = ours and t[-8:-4] == "6304"
            rows.append(None if t is None else {"ours": ours, "place": f.get("53", "") + f.get("58", ""), "stated": f.get("54", ""), "sum": _crc16(t[:-4]) if sealed else None})
        return pa.array(rows, pa.struct([("ours", pa.bool_()), ("place", pa.string()), ("stated", pa.string()), ("sum", pa.string())]))

    return parts(c)


def tlv(c: Column, depth: int = 40) -> Column:
    """Two-digit tags with two-digit lengths as a map; null on an overrun, a repeated tag or a bad length.

    depth bounds the fields of one level: the format has 100 tags at most, each once.
    """
    state = F.struct(c.alias("rest"), F.array().cast("array<struct<tag:string,value:string>>").alias("out"), F.lit(True).alias("ok"))

    def step(s: Column, _: Column) -> Column:
        size = F.substring(s["rest"], 3, 2)
        n = size.try_cast("int")
        good = s["rest"].rlike("^[0-9]{4}") & (F.length(s["rest"]) >= n + 4)
        done = s["rest"] == ""
        field = F.struct(F.substring(s["rest"], 1, 2).alias("tag"), F.substr(s["rest"], F.lit(5), F.coalesce(n, F.lit(0))).alias("value"))
        return F.struct(
            F.when(done | ~good, s["rest"]).otherwise(F.substr(s["rest"], n + 5, F.length(s["rest"]))).alias("rest"),
            F.when(done | ~good, s["out"]).otherwise(F.concat(s["out"], F.array(field))).alias("out"),
            (s["ok"] & (done | good)).alias("ok"),
        )

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), state, step)
    fields = folded["out"]
    unique = F.size(F.array_distinct(F.transform(fields, lambda f: f["tag"]))) == F.size(fields)
    return F.when(folded["ok"] & (folded["rest"] == "") & (c != "") & unique, F.map_from_entries(fields))


def readable(c: Column) -> Column:
    """Whether decoded bytes are a text: 4 to 4,096 characters, 95 % printable, three letters and three different ones."""
    n = F.length(c)
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    printable = F.length(F.regexp_replace(c, r"[\p{C}&&[^\t\n\r]]", ""))
    return n.between(4, 4096) & (printable >= 0.95 * n) & (F.length(letters) >= 3) & (F.size(F.array_distinct(F.split(F.lower(letters), ""))) >= 3)


def decoded(c: Column) -> Column:
    """Text hidden in base64:, hex: or groups of eight bits; null where nothing readable comes out."""
    t = F.trim(c)
    b64, hexa = F.regexp_extract(t, r"^base64:([A-Za-z0-9+/]+={0,2})$", 1), F.regexp_extract(t, r"^hex:((?:[0-9a-fA-F]{2})+)$", 1)
    bits = F.when(t.rlike(r"^[01\s,]{32,}$"), F.regexp_replace(t, r"[^01]", ""))
    octets = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(bits) / 8).cast("int") - 1, F.lit(0))), lambda i: F.lpad(F.conv(F.substr(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    from_bits = F.when((F.length(bits) % 8 == 0) & (F.length(bits) >= 32), F.array_join(octets, ""))
    raw = F.when(b64 != "", F.try_to_binary(b64, F.lit("base64"))).when(hexa != "", F.try_to_binary(hexa, F.lit("hex"))).when(from_bits.isNotNull(), F.try_to_binary(from_bits, F.lit("hex")))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when(readable(text), text)
