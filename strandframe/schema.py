"""Schemas and fixed values of the alignment formats."""

from pyspark.sql import types as T

# Fixed values of the format
CIGAR_OPS = "MIDNSHP=X"
SEQ_ALPHABET = "=ACMGRSVTWYHKDBN"
BAM_MAGIC = b"BAM\x01"
BAI_MAGIC = b"BAI\x01"
BGZF_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
PSEUDO_BIN = 37450
DEFAULT_SEQUENCE_LENGTH = 255_000_000
#: AUX type: (struct code, SAM type)
AUX_TYPES = {"A": ("c", "A"), "c": ("b", "i"), "C": ("B", "i"), "s": ("h", "i"), "S": ("H", "i"), "i": ("i", "i"), "I": ("I", "i"), "f": ("f", "f"), "Z": ("", "Z"), "H": ("", "H")}

CIGAR = T.ArrayType(T.StructType([T.StructField("len", T.IntegerType()), T.StructField("op", T.ByteType())]))
AUX = T.ArrayType(T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("type", T.StringType()), T.StructField("sub_type", T.StringType()),
    T.StructField("i", T.ArrayType(T.LongType())), T.StructField("f", T.ArrayType(T.FloatType())), T.StructField("s", T.StringType()),
]))
ALIGNMENT = T.StructType([
    T.StructField("read_name", T.StringType()), T.StructField("flag", T.IntegerType()), T.StructField("ref_id", T.IntegerType()),
    T.StructField("ref_name", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("mapq", T.IntegerType()),
    T.StructField("bin", T.IntegerType()), T.StructField("n_cigar_op", T.IntegerType()), T.StructField("cigar", CIGAR),
    T.StructField("next_ref_id", T.IntegerType()), T.StructField("next_pos", T.IntegerType()), T.StructField("t_len", T.IntegerType()),
    T.StructField("l_seq", T.IntegerType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.BinaryType()),
    T.StructField("aux", AUX), T.StructField("file", T.StringType()), T.StructField("voffset", T.LongType()),
])
FAI = T.StructType([T.StructField("name", T.StringType()), T.StructField("len", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("line_blen", T.IntegerType()), T.StructField("line_len", T.IntegerType())])
