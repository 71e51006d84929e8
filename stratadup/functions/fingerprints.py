"""Column functions on fingerprints: 6 bytes, written as 12 lower-case hex digits.

Hex strings compare like the bytes, so minima and sorts need no conversion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12
#: The modulus of 48-bit arithmetic.
SPAN = 1 << 48

# Multipliers and offsets of the affine hashes, 64 each.
MULTIPLIERS = [
    0x76931fac9dab2b36, 0xc248b87d6ae33f9a, 0x62d7183a5d5789e4, 0xb2d6b441e2411dc7,
    0x09e111c7e1e7acb6, 0xf8cac0bb2fc4c8bc, 0x2ae3baaab9165cc4, 0x58e199cb89f51b13,
    0x5f7091a5abb0874d, 0xf3e8cb4543a5eb93, 0xb0441e9ca4c2b0fb, 0x3d30875cbf29abd5,
    0xb1acf38984b35ae8, 0x82809dd4cfe7abc5, 0xc61baa52e053b4c3, 0x643f204ef259d2e9,
    0x8042a948aac5e884, 0xcb3ec7db925643fd, 0x34fdd467e2cca406, 0x035cb2744cb90a63,
    0xe51c973790334394, 0x7e02086541e4c48a, 0x99630aa9aece1538, 0x43a4b190274ebc95,
    0x5f8592e30a2205a4, 0x85846248987550aa, 0xf2094ec59e7931dc, 0x650c7451cc61c0cb,
    0x2c46a1b3f2c349fa, 0xff763c7f8d14ddff, 0x946351744378d62c, 0x59285a8d7915614f,
    0x5a2ac9e0d68aca62, 0x48a9227ab8f1930e, 0xe38ac7a9d239c9b0, 0x26a481e49d53161f,
    0x9a9513fe5271c32e, 0x9c21d156eb9f1bea, 0x57f6ae4f1b1de3b7, 0xfd9cee2d9cca7b4c,
    0x242d26c31d000b7f, 0x90b7fe48a131c7de, 0xbfbe58165266de56, 0xe1edf26939af07ec,
    0x69ab1b17d8db6214, 0x3f2228b51551c3d2, 0xc7de3f5072bd4d18, 0xc3aeb64cb9e8cba8,
    0x1a0f3783ef9012db, 0x00a903566bce3501, 0xd2223908bccfe509, 0x5903acde8fd7ab31,
    0x935db607ea31258f, 0xe90788fdac21bd00, 0x235ad90b73c1e502, 0xe547f90ac56b73a2,
    0xa9073451a897d342, 0xc1d23f55690bb5a1, 0x3392b830b514a6f5, 0x6aaa890d35f0ff59,
    0x763fcba8bd62469f, 0x4fdb4529602ad675, 0x8f8263b034fadbc7, 0xf83bd098236ac562,
]
OFFSETS = [
    0x38667b6ed2b2fcab, 0x04abae8676e318b4, 0x02a7d15b30d2d7dd, 0xb78650cc6af82bc3,
    0xd7aa805b02dd9aa5, 0x23b7374a1323ee6b, 0x516d1b81e5f709c2, 0xc790edaf1c3fa9b0,
    0xa1dbc6dabc2b5ed2, 0x67244c458752002b, 0x106d6381fad58a7e, 0x193657bde0fe0291,
    0x20f8379316891f82, 0x8b8d24a049e5b86d, 0x855bcfed56765f9d, 0xa1ac54caeaf9257a,
    0xbc67b451bc70b0e5, 0x2817dd1b704a6b41, 0x8a83fd4a9ca4c89e, 0x1a6e779f8d9e9df1,
    0x8747591e5b314c05, 0x763edcd59632423c, 0xa83f14d6f073d784, 0xdb2b7001643a6760,
    0xf9f0dd6ddd0a59e2, 0x41dc1ed720287896, 0x286f5cc3addf6c1a, 0xdf6ed35f477b0022,
    0x981e5e1fbfe1bfb8, 0xe26b5ba93253275b, 0xf6a44b3fa1051cdf, 0xe3b3f5d2725a9a58,
    0x0fd5b04525b3182f, 0xcd2b3fda124aca3c, 0x901406a2b55cd8b9, 0x5d48d13e379f1ccb,
    0xcdfc39fee4acc552, 0x3aa0bdef57e63a1f, 0x81cbaba9f45caaed, 0x48d06bfb3d168360,
    0x42bed57cac84761b, 0xfeb59a0c81304908, 0xbb781e4bbdf230d2, 0xe977374b97bd0b6b,
    0x7d38b736428826a0, 0xf2729be2290256dc, 0x304e875c9d4b3fb2, 0x125ae3d0cd3130d6,
    0x3764bdca939cad56, 0x290bfd3ea9c74cbe, 0xcb32a05648982795, 0xb2083afde0219374,
    0x09389bfad721f43d, 0x458475badc30a38d, 0xbad72854902bd01a, 0xcf81993a3acb4302,
    0xf4b8eac294a96d54, 0x18321da9c9410111, 0x00df012104bc0103, 0x110018201acdf900,
    0xcc490ab371f1138f, 0x9327ad39875abef4, 0xabbb29843297f091, 0x0932998100000ac0,
]


def of_text(text: Column) -> Column:
    """The 48-bit MD5 of a string's UTF-8 bytes."""
    return F.substring(F.md5(text.cast("binary")), 1, DIGITS)


def of_hash(hexes: Column) -> Column:
    """The leading 6 bytes of a longer hash."""
    return F.substring(F.lower(hexes), 1, DIGITS)


def byte(fp: Column, i: int) -> Column:
    return F.conv(F.substring(fp, 2 * i + 1, 2), 16, 10).cast("long")


def little_endian(fp: Column, n: int) -> Column:
    """The first n bytes as an unsigned integer, lowest byte first."""
    swapped = F.concat(*[F.substring(fp, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.conv(swapped, 16, 10).cast("long")


def is_boundary(fp: Column, mask_span: int) -> Column:
    """Whether the low bits of the first four bytes are zero; `mask_span` is a power of two."""
    return F.pmod(little_endian(fp, 4), F.lit(mask_span)) == 0


def affine(fp: Column, j: int) -> Column:
    """The j-th affine hash, modulo 2**48, in decimals so that nothing overflows."""
    k, b = MULTIPLIERS[j] % SPAN, OFFSETS[j] % SPAN
    value = little_endian(fp, 6).cast("decimal(15,0)")
    product = F.lit(k).cast("decimal(15,0)") * value + F.lit(b).cast("decimal(15,0)")
    return F.pmod(product, F.lit(SPAN).cast("decimal(15,0)")).cast("long")
