"""Fixed values.

Everything in this module is data that has to keep exactly these values for results to be right:
word lists, lookup tables, price floors, seed pages.  There is no logic here.  All of it is small and
of fixed size, so it may be inlined into plans as literals.
"""

# The part categories.
CATEGORIES = (
    "gpu", "cpu", "ram", "ssd", "hdd", "psu",
    "case", "motherboard", "cooling", "monitor",
)

# Shops that list parts, in refresh order; this order breaks ties between shops' rows.
PART_SOURCES = (
    "czone.com.pk", "zahcomputers.pk", "amdhouse.pk", "rbtechngames.com", "junaidtech.pk",
    "techarc.pk", "pakbyte.pk", "redtech.pk", "techmatched.pk",
)

# Shops that list complete systems.
PREBUILT_SOURCES = ("zestrogaming.com", "redtech.pk", "techmatched.pk")

# Lowest believable price by category. hdd and monitor have none.
PRICE_FLOORS = {
    "gpu": 4000, "cpu": 8000, "ram": 1000, "motherboard": 8000,
    "ssd": 2500, "psu": 5000, "case": 3000, "cooling": 500,
}

# A name containing one of these is not a PC part, whatever its category.
BLOCKED_TERMS = (
    "flash drive", "usb drive", "external hard drive", "portable hard drive", "external ssd",
    "portable ssd", "optical drive", "dvd writer", "dvd drive", "blu-ray", "thermal paste",
    "thermal grease", "thermal compound", "thermal grizzly", "non-nand", "non nand",
)

# Further blocked terms of single categories.
BLOCKED_TERMS_BY_CATEGORY = {
    "gpu": ("card holder", "graphics card holder", "gpu holder", "gpu support", "card support",
            "nvlink", "sli bridge"),
    "ssd": ("enclosure", "docking station", "microsd", "micro sd", "sdxc", "sdhc", "adapter card",
            "pcie adapter", "m.2 adapter", "nvme adapter", "fulfill kit"),
    "cooling": ("thermal pad", "fan controller", "fan hub", "rpd grease", "thermal grease",
                "thermal paste"),
    "psu": ("case with", "chassis with"),
}

# Spec fields, in stored order.
SPEC_FIELDS = (
    "brand", "socket", "vram", "ddr_type", "speed", "chipset", "wattage", "rating",
    "form_factor", "type", "aio_size", "fan_size", "interface", "capacity",
)

# Spec fields offered as filters, by category.
FACET_FIELDS = {
    "cpu": ("brand", "socket"),
    "gpu": ("brand", "vram"),
    "ram": ("brand", "ddr_type", "speed"),
    "motherboard": ("brand", "socket", "chipset"),
    "psu": ("brand", "wattage", "rating"),
    "case": ("brand", "form_factor"),
    "cooling": ("brand", "type", "aio_size", "fan_size"),
    "ssd": ("brand", "interface", "capacity"),
    "hdd": ("brand",),
    "monitor": ("brand",),
}

# Brand needles. The first needle of this list found in a lower-cased name decides, so
# the order matters; needles of up to three letters count only as whole words.
BRANDS = (
    ("cooler master", "Cooler Master"), ("be quiet!", "be quiet!"), ("lian li", "Lian Li"),
    ("g.skill", "G.Skill"), ("g skill", "G.Skill"), ("western digital", "WD"),
    ("thermalright", "Thermalright"), ("thermaltake", "Thermaltake"), ("powercolor", "PowerColor"),
    ("super flower", "Super Flower"), ("id-cooling", "ID-Cooling"), ("teamgroup", "TeamGroup"),
    ("viewsonic", "ViewSonic"), ("kingston", "Kingston"), ("samsung", "Samsung"),
    ("seagate", "Seagate"), ("gigabyte", "Gigabyte"), ("sapphire", "Sapphire"),
    ("asrock", "ASRock"), ("seasonic", "Seasonic"), ("corsair", "Corsair"), ("fractal", "Fractal"),
    ("phanteks", "Phanteks"), ("deepcool", "DeepCool"), ("gamemax", "GameMax"),
    ("twinmos", "TwinMOS"), ("hiksemi", "HikSemi"), ("gainward", "Gainward"),
    ("crucial", "Crucial"), ("hyperx", "HyperX"), ("patriot", "Patriot"), ("apacer", "Apacer"),
    ("lexar", "Lexar"), ("noctua", "Noctua"), ("cougar", "Cougar"), ("antec", "Antec"),
    ("radeon", "AMD"), ("ryzen", "AMD"), ("geforce", "NVIDIA"), ("zotac", "ZOTAC"),
    ("palit", "Palit"), ("arktek", "Arktek"), ("adata", "ADATA"), ("dahua", "Dahua"),
    ("hikvision", "Hikvision"), ("intel", "Intel"), ("nvidia", "NVIDIA"), ("asus", "ASUS"),
    ("nzxt", "NZXT"), ("benq", "BenQ"), ("dell", "Dell"), ("lenovo", "Lenovo"),
    ("philips", "Philips"), ("iiyama", "iiyama"), ("amd", "AMD"), ("msi", "MSI"), ("xpg", "XPG"),
    ("xfx", "XFX"), ("pny", "PNY"), ("aoc", "AOC"), ("wd", "WD"), ("lg", "LG"),
)

# Accepted figures in part names.
GPU_MEMORY_GB = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32)
SSD_CAPACITY_GB = (64, 128, 240, 256, 480, 500, 512, 960, 1000)
CHIPSET_SERIES = (
    "A3", "A4", "A5", "A6", "B3", "B4", "B5", "B6", "B7", "X3", "X4", "X5", "X6", "X8",
    "H3", "H4", "H5", "H6", "H7", "Z3", "Z4", "Z5", "Z6", "Z7", "Z8",
)

# Component fields of a complete system, in stored order.
COMPONENT_FIELDS = (
    "cpu", "gpu", "ram", "storage", "motherboard", "psu", "case", "cpu_cooler", "case_fans", "os",
)

# Labels shops print next to a component, and the field each one fills.
COMPONENT_LABELS = {
    "cpu": "cpu", "processor": "cpu",
    "gpu": "gpu", "graphics card": "gpu", "graphic card": "gpu", "graphics": "gpu",
    "ram": "ram", "memory": "ram",
    "storage": "storage", "ssd": "storage", "hdd": "storage", "hard drive": "storage",
    "motherboard": "motherboard", "mobo": "motherboard",
    "psu": "psu", "power supply": "psu",
    "case": "case", "casing": "case", "cabinet": "case",
    "cpu cooler": "cpu_cooler", "cooler": "cpu_cooler", "cooling": "cpu_cooler",
    "os": "os", "operating system": "os",
}

# Labels only some of the shops use.
COMPONENT_LABELS_BY_SOURCE = {
    "zestrogaming.com": {"case fans": "case_fans", "fans": "case_fans"},
    "redtech.pk": {"nvme": "storage"},
    "techmatched.pk": {"vga": "gpu", "nvme": "storage", "m.2": "storage", "windows": "os"},
}

# Words in a title that mark a page as something other than a complete system.
NOT_A_SYSTEM = {
    "zestrogaming.com": (),
    "redtech.pk": ("graphic card", "graphics card", "processor", "monitor", "keyboard", "mouse",
                   "headset", "speaker", "chair", "desk", "power supply unit", "motherboard only",
                   "ram only", "ssd only"),
    "techmatched.pk": ("gaming case", "keyboard", "mouse", "headset", "monitor", "speaker",
                       "mousepad", "chair", "desk", "rgb fan"),
}

# What the brand choices of the system listing look for in a component text.
CPU_BRAND_WORDS = {"amd": ("ryzen", "amd"), "intel": ("intel", "core i")}
GPU_BRAND_WORDS = {"nvidia": ("rtx", "gtx", "nvidia"), "amd": ("amd", "radeon"), "intel": ("arc",)}

# Slots of a saved part list, in stored order.
BUILD_SLOTS = ("cpu", "gpu", "ram", "motherboard", "psu", "case", "ssd", "cooling")

# Share codes are this many letters or digits.
CODE_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CODE_LENGTH = 6
CODE_ATTEMPTS = 10

# Limits of the quality checks.
PRICE_SANE_RANGE = (100, 2_000_000)
SPEC_COVERAGE_PERCENT = 80
THUMBNAIL_PERCENT = 70
THUMBNAIL_PERCENT_BY_SOURCE = {"amdhouse.pk": 10, "rbtechngames.com": 10}
MIN_DISTINCT_CATEGORIES = 5
FRESH_HOURS = 24

# Where each shop starts, as (seed page pattern, [(path, category), ...]).
SEED_PAGES = {
    "czone.com.pk": ("https://www.czone.com.pk{}", (
        ("/graphic-cards-pakistan-ppt.154.aspx", "gpu"),
        ("/processors-pakistan-ppt.85.aspx", "cpu"),
        ("/motherboards-pakistan-ppt.157.aspx", "motherboard"),
        ("/memory-module-ram-pakistan-ppt.127.aspx", "ram"),
        ("/solid-state-drives-ssd-pakistan-ppt.263.aspx", "ssd"),
        ("/hard-drives-pakistan-ppt.93.aspx", "hdd"),
        ("/power-supply-pakistan-ppt.183.aspx", "psu"),
        ("/casing-pakistan-ppt.168.aspx", "case"),
        ("/cooling-solutions-pakistan-ppt.141.aspx", "cooling"),
        ("/lcd-led-monitors-pakistan-ppt.108.aspx", "monitor"),
    )),
    "zahcomputers.pk": ("https://zahcomputers.pk/shop/?product_cat={}", (
        ("graphics-cards", "gpu"), ("processors", "cpu"), ("motherboard-chipset", "motherboard"),
        ("memory-module-ram", "ram"), ("sata-ssd", "ssd"), ("power-supplies", "psu"),
        ("casing", "case"), ("cooling-solutions", "cooling"), ("monitors", "monitor"),
    )),
    "amdhouse.pk": ("https://amdhouse.pk/product-category/{}/", (
        ("graphics-cards", "gpu"), ("processors", "cpu"), ("motherboards", "motherboard"),
        ("ram", "ram"), ("ssd", "ssd"), ("hdd", "hdd"), ("power-supply", "psu"),
        ("casing", "case"), ("cooling", "cooling"), ("monitors", "monitor"),
    )),
    "rbtechngames.com": ("https://rbtechngames.com/product-category/{}/", (
        ("computers/graphics-card", "gpu"), ("computers/processors", "cpu"),
        ("computers/motherboards", "motherboard"), ("computers/rams", "ram"),
        ("computers/storage", "ssd"), ("computers/power-supplies", "psu"),
        ("computers/casings", "case"), ("computers/cpu-coolers", "cooling"),
        ("computers/monitors", "monitor"),
    )),
    "junaidtech.pk": ("https://www.junaidtech.pk{}", (
        ("/graphics-cards-gpu", "gpu"), ("/processors-cpu", "cpu"), ("/motherboards", "motherboard"),
        ("/ram-memory", "ram"), ("/solid-state-drives-ssd", "ssd"), ("/hard-drives-hdd", "hdd"),
        ("/power-supplies-psu", "psu"), ("/pc-casings", "case"), ("/cooling-solutions", "cooling"),
        ("/monitors-led-tv", "monitor"),
    )),
    "techarc.pk": ("https://techarc.pk/{}/", (
        ("cpu-processors", "cpu"), ("graphics-cards", "gpu"), ("motherboards", "motherboard"),
        ("ram-memory-modules", "ram"), ("storage/solid-state-drives", "ssd"),
        ("power-supplies", "psu"), ("cases", "case"), ("cpu-coolers", "cooling"),
        ("monitors", "monitor"),
    )),
    "pakbyte.pk": ("https://www.pakbyte.pk/collections/{}", (
        ("processors", "cpu"), ("graphic-cards", "gpu"), ("motherboards", "motherboard"),
        ("memory-sticks", "ram"), ("internal-ssd", "ssd"), ("internal-hdd", "hdd"),
        ("power-supplies", "psu"), ("casings", "case"), ("cpu-coolers", "cooling"),
        ("monitors", "monitor"),
    )),
    "redtech.pk": ("https://redtech.pk/product-category/{}/", (
        ("processor", "cpu"), ("graphic-card", "gpu"), ("motherboard", "motherboard"),
        ("ram", "ram"), ("ssd-nvme", "ssd"), ("hard-drive", "hdd"), ("power-supply", "psu"),
        ("gaming-case", "case"), ("cpu-cooler", "cooling"), ("gaming-monitors", "monitor"),
    )),
    "techmatched.pk": ("https://techmatched.pk/product-category/{}/", (
        ("processors", "cpu"), ("graphics-card-in-pakistan", "gpu"), ("motherboards", "motherboard"),
        ("rams", "ram"), ("storage-in-pakistan/find-ssd-prices-in-pakistan", "ssd"),
        ("storage-in-pakistan/hard-drive", "hdd"), ("buy-power-supply-in-pakistan", "psu"),
        ("computer-case", "case"), ("cpu-coolers", "cooling"), ("gaming-monitors", "monitor"),
    )),
}
