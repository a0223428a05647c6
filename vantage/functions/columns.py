"""Column functions: strings, images' values, colours, bit tricks. All stay in generated JVM code."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo=0.0, hi=1.0) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def gaussian(x: Column, sigma: float) -> Column:
    return F.exp(-x * x / F.lit(2.0 * sigma * sigma))


def sinc(x: Column) -> Column:
    """sin(x) / x, and 1 at zero."""
    return F.when(x == 0, 1.0).otherwise(F.sin(x) / F.when(x != 0, x))


def from_gray_code(x: Column, bits: int = 32) -> Column:
    shift = 1
    while shift < bits:
        x = x.bitwiseXOR(F.shiftright(x, shift))
        shift *= 2
    return x


def bound_mirror(v: Column, lo: int, hi: int) -> Column:
    """An index mirrored at the borders of [lo, hi]; below, lo counts once: lo - v, as for lo = 0."""
    return F.when(v < lo, lo - v).when(v > hi, 2 * hi - v).otherwise(v)


def float_to_byte(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.floor((clamp(v, lo, hi) - lo) / (hi - lo) * 255 + 0.5).cast("int")


def byte_to_float(v: Column) -> Column:
    return clamp(v / F.lit(255.0))


def gamma_srgb(v: Column) -> Column:
    """Linear to sRGB."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def gamma_inv_srgb(v: Column) -> Column:
    """sRGB to linear."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


#: Weights of luminosity and luminance, the sRGB to XYZ matrix, and RGB to YCbCr.
LUMINOSITY = (0.21, 0.72, 0.07)
LUMINANCE = (0.30, 0.59, 0.11)
SRGB_TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
RGB_TO_YCBCR = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))


def weighted(weights: tuple[float, ...], *columns: Column) -> Column:
    out = F.lit(0.0)
    for w, c in zip(weights, columns, strict=True):
        out = out + F.lit(w) * c
    return out


def desaturate(kind: str, r: Column, g: Column, b: Column) -> Column:
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    return {"maximum": lambda: most, "lightness": lambda: (most + least) * 0.5, "luminosity": lambda: weighted(LUMINOSITY, r, g, b), "luminance": lambda: weighted(LUMINANCE, r, g, b), "average": lambda: (r + g + b) / 3.0}[kind]()


def xyz_to_xyy(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Chromaticity, zero where the sum is zero."""
    s = x + y + z
    safe = F.when(s != 0, s)
    return F.coalesce(x / safe, F.lit(0.0)), F.coalesce(y / safe, F.lit(0.0))


def punctate(s: Column, delim: str = ",", spacing: int = 3) -> Column:
    """A delimiter before every group of `spacing` characters, counted from the end."""
    return s if spacing < 1 else F.regexp_replace(s, f"(?<=.)(?=(?:.{{{spacing}}})+$)", delim)


def ellipsize(s: Column, chars: int, where: str = "right") -> Column:
    """Longer strings lose their left, middle or right part for three dots. In the middle half of chars, less one, stays on
    either side, so that an even number of chars gives one more."""
    keep, half = max(0, chars - 3), max(0, chars // 2 - 1)
    short = {"left": F.concat(F.lit("..."), F.right(s, F.lit(keep))), "right": F.concat(F.left(s, F.lit(keep)), F.lit("...")), "middle": F.concat(F.left(s, F.lit(half)), F.lit("..."), F.right(s, F.lit(half)))}[where]
    return F.when(F.length(s) <= chars, s).otherwise(short)


def split_tokens(s: Column, delim: str, keep_empty: bool = False) -> Column:
    parts = F.split(s, "\\" + delim)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def simplify(s: Column) -> Column:
    """Upper-case words of letters and digits with one space between; leading other characters leave a space."""
    return F.upper(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]+$", ""), "[^A-Za-z0-9]+", " "))


def clip_whitespace(s: Column) -> Column:
    return F.regexp_replace(s, "^[ \\t]+|[ \\t]+$", "")


def clip_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "[\\r\\n]+$", "")


def normalize_spaces(s: Column) -> Column:
    return F.regexp_replace(s, "[ \\t]+", " ")


def basename(s: Column) -> Column:
    return F.substring_index(F.regexp_replace(s, "/+$", ""), "/", -1)


def dirname(s: Column) -> Column:
    d = F.regexp_extract(F.regexp_replace(s, "/+$", ""), "^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def replace_extension(s: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(s, "\\.[^./]*$", ""), F.lit("." + ext))


def id_ranges(s: Column) -> Column:
    """"0-3,7" -> the ids, ranges may descend."""
    one = lambda x: F.split(x, "-")
    return F.flatten(F.transform(F.split(s, ","), lambda x: F.sequence(one(x)[0].cast("int"), F.element_at(one(x), -1).cast("int"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# --- more scalar functions ---


def gaussian_xx(xx: Column, sigma: float) -> Column:
    """The Gaussian of a squared distance."""
    return F.exp(-xx / F.lit(2.0 * sigma * sigma))


def gaussian_2d(x: Column, y: Column, sigma_x: float, sigma_y: float) -> Column:
    return F.exp(-(x * x / F.lit(2.0 * sigma_x * sigma_x) + y * y / F.lit(2.0 * sigma_y * sigma_y)))


def round_half_away(x: Column) -> Column:
    return F.when(x > 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("double")


def interpolate(values: list[Column], weights: list[float], byte: bool = False) -> Column:
    """The weighted sum; of bytes rounded half up."""
    out = weighted(tuple(weights), *(v.cast("double") for v in values))
    return F.floor(out + 0.5).cast("int") if byte else out


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def fastpow(x: Column, n: int) -> Column:
    """x to a whole power, by repeated squaring."""
    out = F.lit(1.0)
    while n:
        if n & 1:
            out = out * x
        x, n = x * x, n >> 1
    return out


def int_to_byte(v: Column) -> Column:
    return F.least(F.abs(v), F.lit(255)).cast("int")


def raw_to_byte(v: Column, lo: int = 0, hi: int = 65535) -> Column:
    """16-bit values of a range to bytes, cut off downwards."""
    return F.floor(255.0 * (F.least(F.lit(hi), F.greatest(F.lit(lo), v)) - lo) / F.lit(float(hi - lo))).cast("int")


def raw_to_float(v: Column) -> Column:
    return clamp(v / F.lit(65535.0))


def gamma_correct(v: Column, power: float) -> Column:
    return F.pow(v, F.lit(power))


def gamma_correct_byte(v: Column, power: float) -> Column:
    return F.floor(F.pow(v / F.lit(255.0), F.lit(power)) * 255.0 + 0.5).cast("int")


def subtract_byte(a: Column, b: Column) -> Column:
    """a - b of bytes, which wraps below zero."""
    return F.pmod(a - b, F.lit(256))


def difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


#: XYZ to sRGB, and YCbCr to RGB.
XYZ_TO_SRGB = ((3.2410, -1.5374, -0.4986), (-0.9692, 1.8760, 0.0416), (0.0556, -0.2040, 1.0570))
YCBCR_TO_RGB = ((1.0, 0.0, 1.402), (1.0, -0.34414, -0.71414), (1.0, 1.772, 0.0))


def color_matrix(m: tuple[tuple[float, ...], ...], *v: Column) -> list[Column]:
    return [weighted(row, *v) for row in m]


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    y, cb, cr = color_matrix(RGB_TO_YCBCR, r, g, b)
    return [y, cb + 0.5, cr + 0.5]


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    return color_matrix(YCBCR_TO_RGB, y, cb - 0.5, cr - 0.5)


def xyy_to_xyz(x: Column, y: Column, luma: Column) -> list[Column]:
    """From chromaticity and luminance; zero where y is zero."""
    ratio = luma / F.nullif(y, F.lit(0.0))
    return [F.coalesce(c, F.lit(0.0)) for c in (x * ratio, F.when(y != 0, luma), (1 - x - y) * ratio)]


def expand_grayscale(v: Column) -> list[Column]:
    return [v, v, v]


def reduce_alpha(channels: list[Column]) -> list[Column]:
    return channels[:-1]


def tone_map(v: Column, lo: float, hi: float, gamma: float = 1.0, highlight: bool = False) -> Column:
    """Bytes of a value range with gamma. With highlight, values below, above and not numbers are blue, red and magenta
    colours as (r, g, b) arrays; else grey ones."""
    byte = F.floor(F.pow(clamp((v - lo) / (hi - lo)), F.lit(gamma)) * 255.0 + 0.5).cast("int")
    grey = F.array(byte, byte, byte)
    if not highlight:
        return F.when(F.isnan(v), F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(grey)
    color = lambda *c: F.array(*map(F.lit, c))
    return F.when(F.isnan(v), color(255, 0, 255)).when(v < lo, color(0, 0, 255)).when(v > hi, color(255, 0, 0)).otherwise(grey)


# --- more strings and paths ---


def to_text(x: Column) -> Column:
    return x.cast("string")


def get_fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def get_filled(x: Column, width: int, fill: str = "0") -> Column:
    """Filled from the left; longer texts stay whole."""
    s = x.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def convert(s: Column, kind: str, strict: bool = False) -> Column:
    """The number that a string starts with, 0 if none; strict: null unless the whole string, but for spaces before, is one."""
    pattern = "[+-]?\\d+" if kind in ("int", "long") else "[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?"
    if strict:
        return F.when(s.rlike(rf"^\s*{pattern}$"), F.trim(s).try_cast(kind))
    return F.coalesce(F.regexp_extract(s, rf"^\s*({pattern})", 1).try_cast(kind), F.lit(0).cast(kind))


#: Names of types and their sizes in bytes.
TYPE_SIZES = {"sint8": 1, "uint8": 1, "sint16": 2, "uint16": 2, "sint32": 4, "uint32": 4, "sint64": 8, "uint64": 8, "float": 4, "double": 8}
TYPE_NAMES = {"int8": "sint8", "uint8": "uint8", "int16": "sint16", "uint16": "uint16", "int32": "sint32", "uint32": "uint32", "int64": "sint64", "uint64": "uint64", "float32": "float", "float64": "double"}


def size_of_type(name: Column) -> Column:
    """Bytes of a value of the type of this name, 0 for others."""
    sizes = F.create_map(*(F.lit(x) for pair in TYPE_SIZES.items() for x in pair))
    return F.coalesce(F.element_at(sizes, name), F.lit(0))


def name_of_type(dtype: Column) -> Column:
    """The name of a machine type (int8, float32, ...); null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair)), dtype)


def lowercase(s: Column) -> Column:
    """Latin letters A to Z only."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uppercase(s: Column) -> Column:
    """Latin letters a to z only."""
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@cache
def case_pairs(upper: bool) -> tuple[str, str]:
    """Letters and what each becomes alone: one for one (sharp s has its own capital), whatever stands beside it."""
    pairs = []
    for c in map(chr, (k for k in range(sys.maxunicode + 1) if not 0xD800 <= k <= 0xDFFF)):
        whole = c.upper() if upper else c.lower()
        if len(whole) > 1:
            whole = (c.title() if len(c.title()) == 1 else c) if upper else whole[0]
        pairs.append((c, "\u1e9e" if upper and c == "\xdf" else whole))
    return tuple("".join(x) for x in zip(*(p for p in pairs if p[0] != p[1]), strict=True))


def lower_letters(s: Column) -> Column:
    """Each letter of any script by itself in lower case: the number of characters stays, unlike Spark's lower."""
    return F.translate(s, *case_pairs(False))


def upper_letters(s: Column) -> Column:
    """Each letter of any script by itself in upper case: the number of characters stays, unlike Spark's upper."""
    return F.translate(s, *case_pairs(True))


def left(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def size_text(n: Column) -> Column:
    """Bytes for people: 1,000 of a unit go to the next one, one decimal below ten."""
    value = F.when(n < 1000, n.cast("double")).when(n < 1024 * 1000, n / 1024.0).when(n < 1024 * 1024 * 1000, n / 1048576.0).otherwise(n / 1073741824.0)
    unit = F.when(n < 1000, " B").when(n < 1024 * 1000, " KB").when(n < 1024 * 1024 * 1000, " MB").otherwise(" GB")
    return F.concat(F.when(value >= 10, F.format_string("%.0f", F.bround(value, 0))).otherwise(F.format_string("%.1f", value)), unit)


def wordwrap(s: Column, width: int) -> Column:
    """Words of a line put on lines of at most `width` characters, longer words alone; line breaks stay."""
    if width <= 0:
        return s

    def wrap(line: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(width).alias("room"), F.lit(True).alias("first"))

        def step(a: Column, w: Column) -> Column:
            breaks = F.length(w) > a["room"]
            gap = F.when(a["first"], "").when(breaks, "\n").otherwise(" ")
            room = F.when(breaks, F.lit(width)).otherwise(a["room"]) - F.length(w) - 1
            return F.struct(F.concat(a["out"], gap, w).alias("out"), room.alias("room"), F.lit(False).alias("first"))

        return F.aggregate(F.split(line, "[ \t]"), start, step, lambda a: a["out"])

    return F.array_join(F.transform(F.split(s, "\n"), wrap), "\n")


def parse_cmd(s: Column) -> Column:
    """Split at spaces outside double quotes, which go; empty parts stay."""
    start = F.struct(F.array(F.lit("")).alias("parts"), F.lit(False).alias("quoted"))

    def step(a: Column, c: Column) -> Column:
        last = F.element_at(a["parts"], -1)
        grown = F.concat(F.slice(a["parts"], F.lit(1), F.size(a["parts"]) - 1), F.array(F.concat(last, c)))
        parts = F.when(c == '"', a["parts"]).when((c == " ") & ~a["quoted"], F.concat(a["parts"], F.array(F.lit("")))).otherwise(grown)
        return F.struct(parts.alias("parts"), F.when(c == '"', ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, step, lambda a: a["parts"])


def concat_tokens(tokens: Column, at: int, n: int = 0) -> Column:
    """n tokens from index `at` on with a space between; 0: all that follow."""
    return F.array_join(F.slice(tokens, F.lit(at + 1), F.lit(n if n else 2**31 - 1 - at)), " ")


def sanitize_path(s: Column) -> Column:
    """With slashes, none twice, and none at the end but for the root."""
    slashes = F.regexp_replace(F.translate(s, "\\", "/"), "/+", "/")
    return F.when(F.length(slashes) > 1, F.regexp_replace(slashes, "/$", "")).otherwise(slashes)


def is_absolute(s: Column) -> Column:
    return s.startswith("/")


def join_path(a: Column, b: Column) -> Column:
    """b below a, or b where it is absolute."""
    clean = sanitize_path(b)
    return F.when(is_absolute(clean), clean).otherwise(F.concat(sanitize_path(a), F.lit("/"), clean))


def abspath(s: Column, cwd: str) -> Column:
    return join_path(F.lit(cwd), s)


def remove_extension(s: Column) -> Column:
    """Without the last dot and what follows it."""
    return F.regexp_replace(s, "\\.[^.]*$", "")


def has_jpeg_extension(s: Column) -> Column:
    return lowercase(s).rlike("\\.jpe?g$")
