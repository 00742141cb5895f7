"""Specifications read out of part names."""

from rigbook import fixed
from rigbook.functions.specs import with_specs
from samples.titles import TITLES

# Names and the specifications to be read from them; None means nothing must be found.
CASES = [
    ("AMD Ryzen 5 5600 Processor", "cpu", "brand", "AMD"),
    ("AMD Ryzen 7 7700X AM5 Box", "cpu", "brand", "AMD"),
    ("Intel Core i5-13600K LGA1700", "cpu", "brand", "Intel"),
    ("Sapphire PULSE RX 6600 8GB GDDR6", "gpu", "brand", "Sapphire"),
    ("ASUS ROG STRIX RTX 4070 12GB GDDR6X", "gpu", "brand", "ASUS"),
    ("G.Skill Ripjaws V 16GB DDR4 3200MHz", "ram", "brand", "G.Skill"),
    ("Cooler Master MasterLiquid 240L AIO", "cooling", "brand", "Cooler Master"),
    ("WD Blue SN580 1TB NVMe SSD", "ssd", "brand", "WD"),
    ("Generic No Name 500W PSU", "psu", "brand", None),
    ("AMD Ryzen 5 7600 AM5 Processor", "cpu", "socket", "AM5"),
    ("AMD Ryzen 5 5600X AM4", "cpu", "socket", "AM4"),
    ("Intel Core i5-12400 LGA1700", "cpu", "socket", "LGA1700"),
    ("Intel Core i7-12700K LGA 1700", "cpu", "socket", "LGA1700"),
    ("Intel Core Ultra 9 285K LGA 1851", "cpu", "socket", "LGA1851"),
    ("Intel Core i5-13600K Desktop Processor", "cpu", "socket", None),
    ("Sapphire PULSE AMD Radeon RX 6400 4GB GDDR6", "gpu", "vram", "4GB"),
    ("ASUS ROG STRIX RTX 4070 12GB GDDR6X", "gpu", "vram", "12GB"),
    ("MSI GeForce RTX 4060 8GB Gaming X", "gpu", "vram", "8GB"),
    ("ASUS GeForce GT 1030 Graphics Card", "gpu", "vram", None),
    ("Corsair Vengeance LPX 16GB DDR4 3200MHz", "ram", "ddr_type", "DDR4"),
    ("G.Skill Trident Z5 32GB DDR5 6000MHz", "ram", "ddr_type", "DDR5"),
    ("Kingston 16GB DDR4 3200MHz", "ram", "speed", "3200MHz"),
    ("Corsair 32GB DDR5-5600 CL40", "ram", "speed", "5600MHz"),
    ("Corsair Vengeance 8GB DDR4", "ram", "speed", None),
    ("MSI MAG B650 TOMAHAWK WIFI AM5", "motherboard", "socket", "AM5"),
    ("ASUS PRIME Z790-P LGA1700", "motherboard", "socket", "LGA1700"),
    ("Gigabyte B650M DS3H AM5", "motherboard", "chipset", "B650M"),
    ("MSI MEG Z790 ACE LGA1700", "motherboard", "chipset", "Z790"),
    ("ASUS ROG CROSSHAIR X670E HERO AM5", "motherboard", "chipset", "X670E"),
    ("Samsung 870 EVO 500GB SATA SSD", "motherboard", "chipset", None),
    ("Seasonic Focus GX 750W 80 Plus Gold", "psu", "wattage", "750W"),
    ("Seasonic Focus GX 750W 80 Plus Gold", "psu", "rating", "80+ Gold"),
    ("Corsair CV650 650W 80 Plus Bronze", "psu", "rating", "80+ Bronze"),
    ("be quiet! Straight Power 12 850W 80 Plus Platinum", "psu", "rating", "80+ Platinum"),
    ("Generic 500W Power Supply", "psu", "rating", None),
    ("Fractal Design Meshify C ATX Mid-Tower Case", "case", "form_factor", "ATX"),
    ("NZXT H5 Flow Micro-ATX Mid Tower", "case", "form_factor", "Micro-ATX"),
    ("Cooler Master MasterBox Q300L mATX Case", "case", "form_factor", "Micro-ATX"),
    ("Lian Li A4-H2O Mini-ITX Case", "case", "form_factor", "Mini-ITX"),
    ("Generic PC Case Black", "case", "form_factor", None),
    ("Cooler Master MasterLiquid 240L AIO Liquid Cooler", "cooling", "type", "AIO"),
    ("Cooler Master MasterLiquid 240L AIO 240mm", "cooling", "type", "AIO"),
    ("Cooler Master MasterLiquid 240L AIO 240mm", "cooling", "aio_size", "240mm"),
    ("Cooler Master MasterLiquid 240L AIO 240mm", "cooling", "fan_size", None),
    ("NZXT Kraken 360 RGB AIO 360mm", "cooling", "aio_size", "360mm"),
    ("Noctua NH-D15 CPU Air Cooler Dual Tower", "cooling", "type", "Air"),
    ("Thermalright TL-C12C 120mm Case Fan", "cooling", "type", "Fan/Accessory"),
    ("Thermalright TL-C12C 120mm Case Fan", "cooling", "fan_size", "120mm"),
    ("Samsung 980 Pro 1TB NVMe SSD", "ssd", "interface", "NVMe"),
    ("Samsung 870 EVO 500GB SATA SSD", "ssd", "interface", "SATA"),
    ("WD Blue SA510 500GB M.2 SATA SSD", "ssd", "interface", "M.2 SATA"),
    ("Samsung 980 Pro 1TB NVMe SSD", "ssd", "capacity", "1TB"),
    ("Samsung 870 EVO 500GB SATA SSD", "ssd", "capacity", "500GB"),
    ("WD Black SN850X 2TB NVMe", "ssd", "capacity", "2TB"),
    ("ASUS ROG STRIX RTX 4070 12GB AM5", "gpu", "socket", None),
    ("Corsair 16GB DDR5 6000MHz", "ram", "vram", None),
]

# Our own: where rules meet, and where scripts other than Latin come in.
EDGE_CASES = [
    ("MSI GeForce RTX 4060", "gpu", "brand", "NVIDIA"),
    ("Gigabyte GeForce RTX 4060", "gpu", "brand", "Gigabyte"),
    ("Western Digital Green", "hdd", "brand", "WD"),
    ("Owd Panel", "monitor", "brand", None),
    ("Größe WD", "hdd", "brand", "WD"),
    ("Card 11GB GDDR6", "gpu", "vram", "11GB"),
    ("Card 11GB 8GB", "gpu", "vram", None),
    ("Card 08GB", "gpu", "vram", "8GB"),
    ("Kit 1333MHz 3200MHz", "ram", "speed", None),
    ("Kit 1600MHz", "ram", "speed", "1600MHz"),
    ("Kit 12001 MHz", "ram", "speed", None),
    ("Kit DDR4-0800", "ram", "speed", "0800MHz"),
    ("Unit 299W", "psu", "wattage", None),
    ("Unit 2000w", "psu", "wattage", "2000W"),
    ("Unit 80+gold", "psu", "rating", "80+ Gold"),
    ("Board B250 X370", "motherboard", "chipset", "X370"),
    ("Box E-ATX and ATX", "case", "form_factor", "E-ATX"),
    ("Box ITX", "case", "form_factor", "ITX"),
    ("Liquid Cooler 360mm", "cooling", "type", None),
    ("Liquid Cooler 360mm", "cooling", "fan_size", "360mm"),
    ("Drive 0.4TB 512GB", "ssd", "capacity", "512GB"),
    ("Drive 1.0TB", "ssd", "capacity", "1.0TB"),
    ("Drive 30TB", "ssd", "capacity", None),
    ("Karte ١٢GB GDDR6", "gpu", "vram", "١٢GB"),
    ("Karte ١٢GB", "gpu", "vram", "12GB"),
]


def read(spark, names):
    rows = spark.createDataFrame(sorted(set(names)), "name string, category string")
    return {(r["name"], r["category"]): r["specs"] for r in with_specs(rows).collect()}


def test_known_names(spark):
    cases = CASES + EDGE_CASES
    specs = read(spark, [(name, category) for name, category, _, _ in cases])
    wrong = [(name, field, expected, specs[name, category] and specs[name, category][field])
             for name, category, field, expected in cases
             if (specs[name, category] and specs[name, category][field]) != expected]
    assert wrong == []


def test_sample_titles_have_the_specs_noted_beside_them(spark):
    cases = [(title, category, specs) for category, titles in TITLES.items() for title, specs in titles]
    found = read(spark, [(title, category) for title, category, _ in cases])
    for title, category, specs in cases:
        row = found[title, category]
        assert {f: row[f] for f in fixed.SPEC_FIELDS if row and row[f] is not None} == specs, title


def test_nothing_found_is_null(spark):
    assert set(read(spark, [("", "cpu"), ("Plain thing", "monitor")]).values()) == {None}


def test_runs_without_python(spark):
    rows = spark.createDataFrame([("x", "cpu")], "name string, category string")
    plan = with_specs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
