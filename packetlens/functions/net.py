"""IPv4 columns (inventory C11-C15): validation, integer form, shared subnet, flags.

Everything is a native expression: a regex check, ``substring_index`` + shifts
for the integer form, XOR + bit length for the shared prefix, and range predicates for
the address classes.  No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ColumnLike, c

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Four dotted decimal octets 0-255, no leading zeros, nothing else.
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

MASK32 = 0xFFFFFFFF

# Fixed values (IANA special-purpose IPv4 blocks as the standard Python
# ``ipaddress`` module classifies them), start address and prefix length.
PRIVATE_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.0.170", 31), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("240.0.0.0", 4), ("255.255.255.255", 32),
]
PRIVATE_EXCEPTIONS = [("192.0.0.9", 32), ("192.0.0.10", 32)]
LOOPBACK_BLOCK = ("127.0.0.0", 8)
MULTICAST_BLOCK = ("224.0.0.0", 4)
LINK_LOCAL_BLOCK = ("169.254.0.0", 16)
# Values treated as "no address" by the private/loopback/multicast/link-local flags.
PLACEHOLDERS = ["", "0", "0.0.0.0"]


def _addr(text: str) -> int:
    a, b, cc, d = (int(x) for x in text.split("."))
    return (a << 24) | (b << 16) | (cc << 8) | d


def _in_block(n: Column, block: tuple[str, int]) -> Column:
    start = _addr(block[0])
    end = start + (1 << (32 - block[1])) - 1
    return n.between(F.lit(start), F.lit(end))


def valid_ipv4(col: ColumnLike) -> Column:
    """C11: the text if it is a valid dotted IPv4 address, else null."""
    x = c(col)
    return F.when(x.rlike(IPV4_PATTERN), x)


def ipv4_to_long(col: ColumnLike) -> Column:
    """Dotted IPv4 text -> 32-bit value as long; null if not strictly valid."""
    x = c(col)
    # Spark computes a ``split`` below ``when`` anew for every octet taken from it; these only look for the dots
    head, tail = F.substring_index(x, ".", 2), F.substring_index(x, ".", -2)
    value = (F.shiftleft(F.substring_index(head, ".", 1).cast("long"), 24)
             + F.shiftleft(F.substring_index(head, ".", -1).cast("long"), 16)
             + F.shiftleft(F.substring_index(tail, ".", 1).cast("long"), 8)
             + F.substring_index(tail, ".", -1).cast("long"))
    return F.when(x.rlike(IPV4_PATTERN), value)


def long_to_ipv4(col: ColumnLike) -> Column:
    """32-bit value -> dotted text."""
    n = c(col).cast("long")
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string")
                              for s in (24, 16, 8, 0)])


def bit_length_of(n: Column) -> Column:
    """Number of significant bits of a non-negative long (0 for 0); one reference to ``n``."""
    return F.length(F.ltrim(F.bin(n), F.lit("0")))


def _mask_text(prefix: int) -> str:
    m = (MASK32 << (32 - prefix)) & MASK32
    return ".".join(str((m >> s) & 255) for s in (24, 16, 8, 0))


# Netmask text by number of host bits (0..32), built from the prefix rule.
MASK_BY_HOST_BITS = [_mask_text(32 - h) for h in range(33)]


def shared_subnet_mask(a: ColumnLike, b: ColumnLike, default: str | None = None,
                       a_long: ColumnLike | None = None, b_long: ColumnLike | None = None) -> Column:
    """C14: netmask of the longest common prefix of two IPv4 addresses.

    Equal addresses give 255.255.255.255, no shared leading bit 0.0.0.0; a null
    or invalid side gives ``default``.  Each address is parsed once: the XOR's
    bit length indexes a 33-entry mask table.
    """
    x = c(a_long) if a_long is not None else ipv4_to_long(a)
    y = c(b_long) if b_long is not None else ipv4_to_long(b)
    table = F.array(*[F.lit(t) for t in MASK_BY_HOST_BITS])
    xr = x.bitwiseXOR(y)
    mask = F.element_at(table, bit_length_of(xr) + 1)
    return F.when(xr.isNotNull(), mask).otherwise(F.lit(default).cast("string"))


def ip_flags(col: ColumnLike, prefix: str | None = None, as_long: ColumnLike | None = None) -> list[Column]:
    """Five boolean flags ``{col}.is_private`` ... ``{col}.is_unspecified``.

    Null, invalid and placeholder text give false; ``is_unspecified`` is true
    for 0.0.0.0 only.  Pass ``as_long`` (a column already holding
    ``ipv4_to_long(col)``) so the parse runs once per row, not once per flag.
    """
    name = prefix or (col if isinstance(col, str) else "ip")
    x = c(col)
    n = c(as_long) if as_long is not None else ipv4_to_long(col)
    usable = n.isNotNull() & ~x.isin(PLACEHOLDERS)
    private = None
    for blk in PRIVATE_BLOCKS:
        e = _in_block(n, blk)
        private = e if private is None else private | e
    for blk in PRIVATE_EXCEPTIONS:
        private = private & ~_in_block(n, blk)

    def flag(e: Column, guard: Column = usable) -> Column:
        return F.coalesce(guard & e, F.lit(False))

    return [
        flag(private).alias(f"{name}.is_private"),
        flag(_in_block(n, LOOPBACK_BLOCK)).alias(f"{name}.is_loopback"),
        flag(_in_block(n, MULTICAST_BLOCK)).alias(f"{name}.is_multicast"),
        flag(_in_block(n, LINK_LOCAL_BLOCK)).alias(f"{name}.is_link_local"),
        F.coalesce(n == 0, F.lit(False)).alias(f"{name}.is_unspecified"),
    ]


def with_ip_longs(df, *cols_: str):
    """Add ``__ip_{col}`` integer forms so later expressions share one parse per column."""
    return df.withColumns({f"__ip_{x}": ipv4_to_long(x) for x in cols_})
