"""Record fields as Column functions: bit fields, sequence, qualities, tags, text lines."""

from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.functions.cigar import render_cigar
from strandframe.schema import SEQ_ALPHABET

REVERSE = 0x10


def core_fields(bin_mq_nl: Column, flag_nc: Column) -> dict[str, Column]:
    """The bit fields of the two packed words (unsigned, as longs)."""
    return {
        "bin": F.shiftright(bin_mq_nl, 16).cast("int"),
        "mapq": F.shiftright(bin_mq_nl, 8).bitwiseAND(F.lit(255)).cast("int"),
        "l_read_name": bin_mq_nl.bitwiseAND(F.lit(255)).cast("int"),
        "flag": F.shiftright(flag_nc, 16).cast("int"),
        "n_cigar_op": flag_nc.bitwiseAND(F.lit(65535)).cast("int"),
    }


def flag_has(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) != 0


def is_reverse(flag: Column) -> Column:
    return flag_has(flag, REVERSE)


def position(pos: Column, one_based: bool = True) -> Column:
    return pos + F.lit(int(one_based))


def read_name(raw: Column) -> Column:
    """Without the trailing NUL characters."""
    return F.rtrim(raw, F.lit("\0"))


def decode_seq(packed: Column, l_seq: Column) -> Column:
    """Two bases to a byte, the first in the upper half."""
    return F.translate(F.substring(F.hex(packed), F.lit(1), l_seq), "0123456789ABCDEF", SEQ_ALPHABET)


def qual_list(qual: Column, l_seq: Column) -> Column:
    """Qualities as an array; 255 for each base where they are missing (null)."""
    return F.coalesce(qual, F.array_repeat(F.lit(255), l_seq))


def qual_text(qual: Column) -> Column:
    """Qualities as characters from ``!`` on; ``*`` where they are missing."""
    return F.coalesce(F.array_join(F.transform(qual, lambda q: F.char(q + 33)), ""), F.lit("*"))


def qual_array(qual: Column, l_seq: Column) -> Column:
    """Bytes of a scan to an array of ints; null stays null."""
    letters = F.split(F.decode(qual, "ISO-8859-1"), "")
    return F.when(qual.isNotNull(), F.when(l_seq > 0, F.transform(letters, lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>")))


def qual_bytes(qual: Column) -> Column:
    """An array of qualities (0 to 255) to bytes; null stays null."""
    return F.encode(F.array_join(F.transform(qual, lambda q: F.char(q)), ""), "ISO-8859-1")


def float_text(x: float) -> str:
    """A 32-bit float widened and printed with 12 significant digits, with ``.0`` if whole."""
    text = "%.12g" % float(np.float32(x))
    return text if any(c in text for c in ".en") else text + ".0"


def float_texts(values: Column) -> Column:
    """``float_text`` of each element of an array, without Python.

    One pattern for each power of ten, so that each has its formatter ready: format_number rounds the
    exact value, an exact half to the even digit. Lambdas are interpreted, so an element takes the few
    comparisons that find its pattern and one call.
    """
    shown = lambda d, pattern: F.call_function("format_number", d, F.lit(pattern))
    power = "0." + "#" * 11 + "E00"
    #: (where its numbers begin, what prints them)
    ranges = [(0.0, lambda d: F.when(d == 0, d.cast("string")).otherwise(F.replace(shown(d, power), F.lit("E"), F.lit("e"))))]
    for e in range(-4, 12):
        ranges.append((float(f"1e{e}"), lambda d, pattern="0.0" + "#" * (10 - e) if e < 11 else "0'.0'": shown(d, pattern)))
    odd = lambda d: F.when(F.isnan(d), F.lit("nan")).when(d == float("inf"), F.lit("inf")).when(d == float("-inf"), F.lit("-inf"))
    ranges.append((1e12, lambda d: odd(d).otherwise(F.replace(shown(d, power), F.lit("E"), F.lit("e+")))))

    def found(d: Column, some: list) -> Column:
        if len(some) == 1:
            return some[0][1](d)
        half = len(some) // 2
        return F.when(F.abs(d) < some[half][0], found(d, some[:half])).otherwise(found(d, some[half:]))

    return F.transform(values, lambda x: found(x.cast("double"), ranges))


def sam_type(kind: Column) -> Column:
    return F.when(kind.isin("c", "C", "s", "S", "i", "I"), F.lit("i")).otherwise(kind)


def sam_aux(aux: Column, semantics: str = "compat") -> Column:
    """``TAG:type:value`` joined by tabs, arrays by commas, without CG. In compat the type of an
    array is that of its elements; in spec it is B and the values follow their sub-type."""

    def one(a: Column) -> Column:
        array = a["type"] == "B"
        numbers = F.coalesce(F.array_join(F.transform(a["i"], lambda x: x.cast("string")), ","), F.array_join(float_texts(a["f"]), ","), F.lit(""))
        kind = F.when(array, sam_type(a["sub_type"]) if semantics == "compat" else F.lit("B")).otherwise(sam_type(a["type"]))
        lead = [] if semantics == "compat" else [F.when(array & (F.coalesce(F.size(a["i"]), F.size(a["f"]), F.lit(0)) > 0), F.concat(a["sub_type"], F.lit(","))).when(array, a["sub_type"]).otherwise(F.lit(""))]
        return F.when(a["tag"] != "CG", F.concat(a["tag"], F.lit(":"), kind, F.lit(":"), *lead, F.coalesce(a["s"], numbers)))

    # joining leaves out nulls, so CG needs no pass of its own
    return F.array_join(F.transform(aux, one), "\t")


def read_group(aux: Column) -> Column:
    """The first RG tag, or null."""
    return F.get(F.filter(aux, lambda a: a["tag"] == "RG"), F.lit(0))["s"]


def reference_name(ref_id: Column, name: Column) -> Column:
    return F.when(ref_id < 0, F.lit("*")).otherwise(name)


def mate_name(next_ref_id: Column, ref_id: Column, name: Column) -> Column:
    """``*`` without a mate's reference, tested first; ``=`` on the same one; else its name."""
    return F.when(next_ref_id < 0, F.lit("*")).when(next_ref_id == ref_id, F.lit("=")).otherwise(name)


def to_sam(*, read_name: Column, flag: Column, ref_name: Column, pos: Column, mapq: Column, cigar: Column, rnext: Column, next_pos: Column, t_len: Column, seq: Column, qual: Column, aux_text: Column, semantics: str = "compat") -> Column:
    """The record's text line. qual: an array, or null; aux_text: of ``sam_aux``."""
    seq = seq if semantics == "compat" else F.when(F.length(seq) == 0, F.lit("*")).otherwise(seq)
    # one mention of the tags, so that a plan need not keep them, and all else of the line, as columns before it
    tags = F.filter(F.array(aux_text), lambda t: t != "")
    return F.concat_ws("\t", read_name, flag.cast("string"), ref_name, (pos + 1).cast("string"), mapq.cast("string"), render_cigar(cigar, semantics), rnext, (next_pos + 1).cast("string"), t_len.cast("string"), seq, qual_text(qual), tags)


def unpack_int(data: Column, offset: int, width: int, signed: bool = True) -> Column:
    """A little-endian integer of 1, 2, 4 or 8 bytes inside a binary; unsigned 8-byte ones as decimal."""
    text = F.hex(F.substring(data, offset + 1, width))
    value = F.conv(F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(width))]), 16, 10).cast("decimal(20,0)")
    top = 1 << (8 * width)
    if signed:
        return F.when(value >= F.lit(Decimal(top // 2)), value - F.lit(Decimal(top))).otherwise(value).cast("long")
    return value if width == 8 else value.cast("long")


def pack_int(value: Column, width: int) -> Column:
    """An integer as little-endian bytes (two's complement)."""
    text = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * width))
    return F.unhex(F.concat(*[F.substring(text, 2 * (width - 1 - i) + 1, 2) for i in range(width)]))
