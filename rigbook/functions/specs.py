"""Specifications read out of a part name, as column expressions.

One struct per part, NULL if the name tells nothing. Everything stays on the JVM. The brand is one
CASE over the needle list: it stops at the first hit, and measured seven times faster than filtering
an array of needles or matching one long alternation.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import find, find_all, to_int
from rigbook.schemas import SPECS

# The patterns of the spec fields. (?iU) folds case and uses Unicode classes.
SOCKET = r"(?iU)\b(AM[45]|LGA\s?\d{4})\b"
GPU_MEMORY_TYPED = r"(?iU)(\d+)\s*GB\s+GDDR\d*"
GIGABYTES = r"(?iU)\b(\d+)\s*GB\b"
TERABYTES = r"(?iU)\b(\d+(?:\.\d+)?)\s*TB\b"
DDR_TYPE = r"(?iU)\b(L?P?DDR[45]X?)\b"
DDR_SPEED = r"(?iU)DDR[45]-?(\d{4,5})"
CLOCK_SPEED = r"(?iU)(\d{4,5})\s*(?:MHz|MT/s)"
CHIPSET = r"(?iU)\b([ABXHZ]\d{3}[EFMKPS]?)\b"
WATTAGE = r"(?iU)\b(\d{3,4})W\b"
RATING = r"(?iU)80(?:\s+plus|\s*\+)\s*(Bronze|Silver|Gold|Platinum|Titanium|White)"
FORM_FACTORS = (
    ("Mini-ITX", r"(?U)\bmini[-\s]?itx\b"),
    ("Micro-ATX", r"(?U)\bmicro[-\s]?atx\b|\bm-atx\b|\bmatx\b"),
    ("E-ATX", r"(?U)\be[-\s]?atx\b"),
    ("ATX", r"(?U)\batx\b"),
    ("ITX", r"(?U)\bitx\b"),
)
COOLING_TYPES = (
    ("AIO", r"(?U)\b(aio|liquid\s+cool|water\s+cool|hydro|all[\s-]in[\s-]one)\b"),
    ("Air", r"(?U)\b(air[\s-]+cooler|heatsink|cpu[\s-]+cooler|tower[\s-]+cooler?|air[\s-]+tower"
            r"|dual[\s-]+tower)\b"),
    ("Fan/Accessory", r"(?U)\b(case\s+fan|argb\s+fan|rgb\s+fan|thermal\s+paste|thermal\s+pad)\b"),
)
COOLING_SIZE = r"(?iU)\b(80|92|120|140|200|240|280|360|420)\s*mm\b"
SSD_INTERFACES = (("nvme", "NVMe"), ("m.2", "M.2 SATA"), ("sata", "SATA"))

# Accepted ranges, both ends included.
CLOCK_RANGE = (1600, 12000)
WATT_RANGE = (300, 2000)
TERABYTE_RANGE = (0.5, 20.0)


def _first_of(cases) -> Column:
    """CASE WHEN over (condition, value) pairs; NULL if none holds."""
    (condition, value), *rest = cases
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain


def _with_unit(number: Column, accepted: Column, unit: str) -> Column:
    return F.when(accepted, F.concat(number.cast("string"), F.lit(unit)))


def brand(lower_name: Column) -> Column:
    def hit(needle):
        found = lower_name.contains(needle)
        # Testing containment first keeps the regular expression off most names.
        return found & lower_name.rlike(rf"(?iU)\b{needle}\b") if len(needle) <= 3 else found
    return _first_of((hit(needle), F.lit(label)) for needle, label in fixed.BRANDS)


def socket(name: Column) -> Column:
    return F.upper(F.replace(find(name, SOCKET), F.lit(" "), F.lit("")))


def gpu_memory(name: Column) -> Column:
    """A figure in front of a memory type is taken as it stands, any other only if it is a usual one."""
    plain = to_int(find(name, GIGABYTES))
    return F.coalesce(F.concat(find(name, GPU_MEMORY_TYPED), F.lit("GB")),
                      _with_unit(plain, plain.isin(*fixed.GPU_MEMORY_GB), "GB"))


def ddr_type(name: Column) -> Column:
    return F.upper(find(name, DDR_TYPE))


def memory_speed(name: Column) -> Column:
    clock = to_int(find(name, CLOCK_SPEED))
    return F.coalesce(F.concat(find(name, DDR_SPEED), F.lit("MHz")),
                      _with_unit(clock, clock.between(*CLOCK_RANGE), "MHz"))


def chipset(name: Column) -> Column:
    codes = F.transform(find_all(name, CHIPSET), F.upper)
    known = F.filter(codes, lambda c: F.substring(c, 1, 2).isin(*fixed.CHIPSET_SERIES))
    return F.get(known, F.lit(0))


def wattage(name: Column) -> Column:
    watts = to_int(find(name, WATTAGE))
    return _with_unit(watts, watts.between(*WATT_RANGE), "W")


def rating(name: Column) -> Column:
    return F.concat(F.lit("80+ "), F.initcap(F.lower(find(name, RATING))))


def form_factor(lower_name: Column) -> Column:
    return _first_of((lower_name.rlike(p), F.lit(label)) for label, p in FORM_FACTORS)


def cooling_type(lower_name: Column) -> Column:
    return _first_of((lower_name.rlike(p), F.lit(label)) for label, p in COOLING_TYPES)


def cooling_size(name: Column) -> Column:
    return F.concat(find(name, COOLING_SIZE), F.lit("mm"))


def ssd_interface(lower_name: Column) -> Column:
    return _first_of((lower_name.contains(n), F.lit(label)) for n, label in SSD_INTERFACES)


def ssd_capacity(name: Column) -> Column:
    """Terabytes are kept as written; a figure out of range falls through to the gigabytes."""
    terabytes, gigabytes = find(name, TERABYTES), to_int(find(name, GIGABYTES))
    return F.coalesce(
        _with_unit(terabytes, terabytes.try_cast("double").between(*TERABYTE_RANGE), "TB"),
        _with_unit(gigabytes, gigabytes.isin(*fixed.SSD_CAPACITY_GB), "GB"))


def with_specs(parts: DataFrame, name: str = "name", category: str = "category") -> DataFrame:
    """Add (or replace) the ``specs`` struct. A narrow step: no shuffle, no Python."""
    n, low, kind = F.col(name), F.col("_lower_name"), F.col(category)
    fields = {
        "brand": brand(low),
        "socket": F.when(kind.isin("cpu", "motherboard"), socket(n)),
        "vram": F.when(kind == "gpu", gpu_memory(n)),
        "ddr_type": F.when(kind == "ram", ddr_type(n)),
        "speed": F.when(kind == "ram", memory_speed(n)),
        "chipset": F.when(kind == "motherboard", chipset(n)),
        "wattage": F.when(kind == "psu", wattage(n)),
        "rating": F.when(kind == "psu", rating(n)),
        "form_factor": F.when(kind == "case", form_factor(low)),
        "type": F.when(kind == "cooling", cooling_type(low)),
        "interface": F.when(kind == "ssd", ssd_interface(low)),
        "capacity": F.when(kind == "ssd", ssd_capacity(n)),
    }
    size = F.when(kind == "cooling", cooling_size(n))
    temporary = ["_lower_name", "_size", *(f"_{f}" for f in fields)]
    is_aio = F.coalesce(F.col("_type") == "AIO", F.lit(False))
    value = {f: F.col(f"_{f}") for f in fields}
    value["aio_size"] = F.when(is_aio, F.col("_size"))
    value["fan_size"] = F.when(~is_aio, F.col("_size"))
    specs = F.struct(*[value[f].alias(f) for f in fixed.SPEC_FIELDS])
    found = F.coalesce(*[value[f] for f in fixed.SPEC_FIELDS]).isNotNull()
    return (parts
            .withColumn("_lower_name", F.lower(n))
            .withColumns({"_size": size, **{f"_{f}": c for f, c in fields.items()}})
            .withColumn("specs", F.when(found, specs).cast(SPECS))
            .drop(*temporary))
