"""CIGAR operations as Column functions. A CIGAR is an array of (len, op number).

semantics: ``compat`` gives what existing tools of this lineage print (op X reads as M, hard clips
advance the reference, an empty CIGAR is an empty text); ``spec`` follows the format's
specification.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.schema import CIGAR_OPS

#: Op numbers that advance the reference position: M D N = X, and H in compat.
SPEC_ADVANCE = (0, 2, 3, 7, 8)
COMPAT_ADVANCE = (*SPEC_ADVANCE, 5)


def advances(op: Column, semantics: str = "compat") -> Column:
    return op.isin(*(COMPAT_ADVANCE if semantics == "compat" else SPEC_ADVANCE))


def parse_cigar(text: Column) -> Column:
    """Text such as ``5S10M`` to ops; empty, ``*`` and null give no ops."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    number = lambda x: F.substring(x, F.lit(1), F.length(x) - 1).cast("int")
    op = lambda x: (F.call_function("instr", F.lit(CIGAR_OPS), F.right(x, F.lit(1))) - 1).cast("byte")
    return F.transform(parts, lambda x: F.struct(number(x).alias("len"), op(x).alias("op")))


def unpack_cigar(words: Column) -> Column:
    """Packed words (length in the upper 28 bits, op in the lower 4) to ops."""
    return F.transform(words, lambda w: F.struct(F.shiftright(w.cast("long"), 4).cast("int").alias("len"), w.cast("long").bitwiseAND(F.lit(15)).cast("byte").alias("op")))


def real_cigar(cigar: Column, l_seq: Column, aux: Column) -> Column:
    """The ops, or where they are the placeholder ``l_seq S, n N`` of a long CIGAR, those of the CG tag."""
    cg = F.get(F.filter(aux, lambda a: a["tag"] == "CG"), F.lit(0))["i"]
    first, second = F.get(cigar, F.lit(0)), F.get(cigar, F.lit(1))
    placeholder = (F.size(cigar) == 2) & (first["op"] == 4) & (first["len"] == l_seq) & (second["op"] == 3)
    return F.when(placeholder & cg.isNotNull(), unpack_cigar(cg)).otherwise(cigar)


def render_cigar(cigar: Column, semantics: str = "compat") -> Column:
    """Ops to text; an op above 8 raises an error."""

    def one(x: Column) -> Column:
        op = x["op"].cast("int")
        known = F.when(op == 8, F.lit("M" if semantics == "compat" else "X")).when(op < 8, F.substring(F.lit(CIGAR_OPS), op + 1, F.lit(1)))
        return F.concat(x["len"].cast("string"), F.coalesce(known, F.raise_error(F.concat(F.lit("unknown CIGAR op "), op.cast("string"))).cast("string")))

    text = F.array_join(F.transform(cigar, one), "")
    return text if semantics == "compat" else F.when(F.size(cigar) == 0, F.lit("*")).otherwise(text)


def reference_span(cigar: Column, semantics: str = "compat") -> Column:
    """Number of reference positions that the ops advance."""
    return F.aggregate(cigar, F.lit(0), lambda n, x: n + F.when(advances(x["op"], semantics), x["len"]).otherwise(F.lit(0)))


def end_position(pos: Column, cigar: Column, one_based: bool = True, semantics: str = "compat", inclusive: bool = False) -> Column:
    """pos (0-based) + span, + 1 if one_based: one past the last base in either counting.
    inclusive: the last base itself."""
    return pos + reference_span(cigar, semantics) + F.lit(int(one_based) - int(inclusive))


def indels(pos: Column, cigar: Column, one_based: bool = True, semantics: str = "compat") -> Column:
    """struct(insertions, deletions), each an array of (pos, len) with the position of the base before."""
    event = "array<struct<pos:int,len:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(event).alias("insertions"), F.array().cast(event).alias("deletions"))

    def step(acc: Column, x: Column) -> Column:
        here = F.array(F.struct((pos + F.lit(int(one_based) - 1) + acc["at"]).cast("int").alias("pos"), x["len"].alias("len")))
        return F.struct(
            (acc["at"] + F.when(advances(x["op"], semantics), x["len"]).otherwise(F.lit(0))).alias("at"),
            F.when(x["op"] == 1, F.concat(acc["insertions"], here)).otherwise(acc["insertions"]).alias("insertions"),
            F.when(x["op"] == 2, F.concat(acc["deletions"], here)).otherwise(acc["deletions"]).alias("deletions"),
        )

    # the fold copies its lists, so reads without an event, most of them, skip it
    found = F.aggregate(cigar, start, step, lambda acc: F.struct(acc["insertions"].alias("insertions"), acc["deletions"].alias("deletions")))
    none = F.array().cast(event)
    return F.when(F.exists(cigar, lambda x: x["op"].isin(1, 2)), found).when(cigar.isNotNull(), F.struct(none.alias("insertions"), none.alias("deletions")))


def has_indel(text: Column) -> Column:
    """Whether a CIGAR's text has an insertion or a deletion: a test before it is parsed."""
    return F.contains(text, F.lit("I")) | F.contains(text, F.lit("D"))


def indel_at(found: Column, position: Column, check_insertions: Column | bool = True, check_deletions: Column | bool = True) -> Column:
    """found: of ``indels``. True if an insertion is anchored at the position, or a deletion covers it."""
    inserted = F.exists(found["insertions"], lambda e: e["pos"] == position)
    deleted = F.exists(found["deletions"], lambda e: (e["pos"] < position) & (position <= e["pos"] + e["len"]))
    flag = lambda c: c if isinstance(c, Column) else F.lit(c)
    return (flag(check_insertions) & inserted) | (flag(check_deletions) & deleted)
