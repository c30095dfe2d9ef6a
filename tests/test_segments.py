"""Labels of segments: what they read as, what stays open, and stored entries read anew."""

from pyspark.sql import functions as F

from postlens.functions import segments

US, CA = "United States", "Canada"
READ = [
    ("US, CA, Santa Clara", "Santa Clara, CA, United States", US),
    ("US, CA, Remote", "Remote - California, United States", US),
    ("US, TX", "Texas, United States", US),
    ("US, NY, New York", "New York, NY, United States", US),
    ("New York, NY", "New York, NY, United States", US),
    ("Austin, TX", "Austin, TX, United States", US),
    ("745 THURLOW ST:VANCOUVER", "Vancouver, British Columbia, Canada", CA),
    ("16 YORK ST:TORONTO", "Toronto, Ontario, Canada", CA),
    ("Sun Life Toronto One York", "Toronto, Ontario, Canada", CA),
    ("AMER - Canada - Ontario - Toronto - University Ave", "Toronto, Ontario, Canada", CA),
    ("AMER - Canada - Ontario - Offsite/Home", "Ontario, Canada", CA),
    ("AMER - United States - Oregon - Beaverton - North Site", "Beaverton, OR, United States", US),
    ("TORONTO, Ontario, Canada", "Toronto, Ontario, Canada", CA),
    ("CA, ON, Toronto", "Toronto, Ontario, Canada", CA),
    ("CA, Toronto", "Toronto, Ontario, Canada", CA),
    ("Montréal, QC", "Montréal, Quebec, Canada", CA),
    ("Remote - Canada", "Remote - Canada", CA),
    ("Remote, Austin, TX", "Remote - Austin, TX, United States", US),
    ("SANTA CLARA, CA, USA", "Santa Clara, CA, United States", US),
    ("COEUR D'ALENE, ID", "Coeur D'Alene, ID, United States", US),
    ("NIAGARA-ON-THE-LAKE, ON", "Niagara-On-The-Lake, Ontario, Canada", CA),
    ("FOND DU LAC, WI", "Fond du Lac, WI, United States", US),
    ("vancouver, bc", "Vancouver, British Columbia, Canada", CA),
    ("Toronto, ON, Hybrid", "Toronto, Ontario, Canada", CA),
    ("Toronto, ON, Remote", "Remote - Toronto, Ontario, Canada", CA),
    ("Washington, District of Columbia", "Washington, DC, United States", US),
    ("Washington, D.C., United States", "Washington, DC, United States", US),
    ("US, Washington, Seattle", "Seattle, WA, United States", US),
    ("District of Columbia, US", "District of Columbia, United States", US),
    ("Richmond, VA, US", "Richmond, VA, United States", US),
    ("12 Main Street, Canada", "Canada", CA),
]
OPEN = ["Remote", "Hybrid", "London", "CA", "", "   ", None, "Some Random Campus", "Building 4", "Headquarters", "Bengaluru, Karnataka, India", "New York and Toronto Hub", "Austin", "745 THURLOW ST", "CA, Santa Clara", "US, ON, Toronto", "Canada, TX", "US, CA, TX", "ON, QC", "Richmond Hill Toronto Tower", "Canada, Plant 7", "US, One Two Three Four Five"]


def test_labels_read_and_left_open(spark):
    want = {label: (place, country) for label, place, country in READ} | {label: None for label in OPEN}
    df = spark.createDataFrame([(label,) for label in want], "label string")
    got = {r["label"]: r["at"] and tuple(r["at"]) for r in df.select("label", segments.segment_place(F.col("label")).alias("at")).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_what_was_read_reads_the_same_again(spark):
    df = spark.createDataFrame([(place,) for _, place, _ in READ], "label string")
    got = df.select("label", segments.segment_place(F.col("label"))["location"].alias("again")).collect()
    assert [tuple(r) for r in got if r["label"] != r["again"]] == []


def test_repaired_entries(spark):
    entries = [
        ("16 YORK ST:TORONTO", "Canada", None),
        ("Home, Ontario", "Canada", "Offsite"),
        ("US, TX", "Canada", None),
        ("old", "United States of America", "US, CA, Remote"),
        ("Building 4", None, None),
        (None, None, None),
        (" ", "Canada", ""),
    ]
    kind = "array<struct<location:string,country:string,raw_location:string>>"
    df = spark.createDataFrame([(1, entries), (2, []), (3, None)], f"k int, at {kind}")
    once = df.select("k", segments.repaired_entries(F.col("at")).alias("at"))
    twice = once.select("k", segments.repaired_entries(F.col("at")).alias("at"))
    got = {r["k"]: r["at"] and [tuple(x) for x in r["at"]] for r in once.collect()}
    assert got[1] == [
        ("Toronto, Ontario, Canada", "Canada", "16 YORK ST:TORONTO"),
        ("US, TX", "Canada", None),
        ("Remote - California, United States", "United States", "US, CA, Remote"),
        ("Building 4", None, None),
    ]
    assert got[2] == [] and got[3] is None
    assert {r["k"]: r["at"] and [tuple(x) for x in r["at"]] for r in twice.collect()} == got
