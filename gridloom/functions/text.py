"""String expressions: trimming, header names, terms, hashes, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import fixed

NON_WORD = "[^\\p{L}\\p{Nd}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip Unicode white space; an absent value becomes the empty string.

    Most cells start and end in visible ASCII and pass through untouched.
    """
    v = _col(c)
    clean = F.ascii(v).between(33, 126) & F.ascii(F.right(v, F.lit(1))).between(33, 126)
    return F.coalesce(F.when(clean, v).otherwise(F.btrim(v, F.lit(fixed.WHITE_SPACE))), F.lit(""))


def has_content(c: Column | str) -> Column:
    """Not blank. A first byte in visible ASCII settles it without trimming, as does no byte."""
    v = _col(c)
    visible = (v >= F.lit("!")) & (v < F.lit("\x7f"))
    return visible | ((v != "") & (trim_ws(v) != ""))


def header_base(c: Column | str) -> Column:
    """Lower-cased letters and digits, every other run one ``_``, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(trim_ws(c)), NON_WORD, "_"), F.lit("_"))


def terms(c: Column | str) -> Column:
    """Lower-cased letter/digit runs of at least two *bytes*, in order, with repeats."""
    return F.filter(
        F.split(F.lower(F.coalesce(_col(c), F.lit(""))), NON_WORD),
        lambda t: F.octet_length(t) >= fixed.MIN_TERM_BYTES,
    )


def fnv1a(c: Column | str) -> Column:
    """Unsigned 32-bit FNV-1a of the UTF-8 bytes, as a bigint.

    Reading the bytes as Latin-1 gives one character per byte, so a fold over characters
    is a fold over bytes.
    """
    octets = F.split(F.decode(F.encode(_col(c), "utf-8"), "ISO-8859-1"), "")
    hashed = F.aggregate(
        octets,
        F.lit(fixed.FNV_OFFSET).cast("bigint"),
        lambda h, b: (h.bitwiseXOR(F.ascii(b).cast("bigint")) * F.lit(fixed.FNV_PRIME)).bitwiseAND(
            F.lit(0xFFFFFFFF)
        ),
    )
    return F.when(_col(c) == "", F.lit(fixed.FNV_OFFSET).cast("bigint")).otherwise(hashed)


def term_bucket(c: Column | str) -> Column:
    """Sparse vector index of a term.

    Never NULL for the optimizer either: a join on it would otherwise add a not-null
    filter that hashes every occurrence of a term below the counting.
    """
    return hash_bucket(fnv1a(c))


def hash_bucket(hashed: Column | str) -> Column:
    return F.coalesce((_col(hashed) % fixed.SPARSE_BUCKETS).cast("int"), F.lit(0))


def name_uuid(c: Column | str) -> Column:
    """Version-5 UUID of a name in the DNS namespace."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(fixed.UUID_DNS_NAMESPACE_HEX)), F.encode(_col(c), "utf-8"))
    )
    variant = F.substring(
        F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1)
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def table_label(source_file: Column | str, sheet: Column | str, sep: str) -> Column:
    """``file`` or ``file<sep>sheet``."""
    return F.concat(
        _col(source_file),
        F.when(F.coalesce(_col(sheet), F.lit("")) == "", F.lit("")).otherwise(
            F.concat(F.lit(sep), _col(sheet))
        ),
    )
