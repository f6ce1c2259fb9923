"""Published signatures and a curated alias subset, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.hashing import signature_checksum
from cohortforge.functions.staging import literal_rows

# Published gene lists, in their listed order, with their scoring method.
PROSTATE_20 = (
    "ABCB6 ALDOA AMH ANKZF1 ANLN COL5A1 ESRP1 FAM216A GAL3ST1 HMMR IGFBP3 KDM3A LOXL2 PPFIA4 "
    "PPP2R5B SLC16A1 SLC6A8 STC2 WSB1 YEATS2"
)
RAGNUM_32 = (
    "ASF1B ASPM BIRC5 BUB3 CENPE CENPU CMTM3 DONSON DTL FOXM1 G6PD HJURP MCM2 MEP1A MTMR2 TRIP13 "
    "ZWINT TDG UNG XRCC6 ADM DDIT4 DSP FER1L4 HILPDA P4HA1 PGAM4 PKM RIMKLA RNASE4 SCD SPAG4"
)
TOUSTRUP_15 = (
    "ADM ALDOA ANKRD37 BNIP3 BNIP3L FAM162A EGLN3 KCTD11 LOX NDRG1 P4HA1 P4HA2 PDK1 PFKFB3 SLC2A1"
)
YANG_28 = {
    "ADAMTS4": 0.208143369,
    "ATF3": -0.182281129,
    "BHLHE40": 0.145486214,
    "BTG2": -0.383633755,
    "CSRNP1": 0.064308417,
    "CYR61": 0.40495632,
    "EGR1": -0.396671892,
    "EGR2": 0.314855084,
    "EGR3": -0.298747262,
    "FOSB": -0.042448357,
    "FOSL2": 0.176084142,
    "GEM": -0.138491418,
    "JUNB": 0.213008876,
    "KLF10": -0.183908536,
    "KLF6": 0.208046534,
    "LIF": 0.325537409,
    "MCL1": 0.306647257,
    "NR4A3": -0.059548777,
    "PPP1R15A": -0.006602269,
    "RHOB": 0.220516453,
    "SELE": -0.103118261,
    "SIK1": 0.290011507,
    "SLC2A14": 0.196779232,
    "SLC2A3": -0.28084907,
    "SOCS3": 0.088841536,
    "THBS1": -0.162059422,
    "TIPARP": -0.553245162,
    "ZFP36": -0.14218079,
}
# Checksums pinned when each list was verified against its publication.
CHECKSUMS = {
    "prostate20": "sha256:034a14859d93b10f9ec26c8244f3c1a4406d2e5d3616ad255c36fd9714d175b6",
    "ragnum32": "sha256:8f61699512413c34448e35fe73e387d6e5329d8b90f3f50c7e8b05099c4c5c35",
    "toustrup15": "sha256:e300e4033cadb09cf99c28d66e82edada9e07022ced92ad4b9cdc03fe10a8fb5",
    "yang28": "sha256:b5a681449acf493b3396148481a6a6f4f0b0e555ca7b4418ca076c1ab33732d3",
}
# Retired symbol and its approved successor.
ALIASES = [
    ("AK3L1", "AK4"),
    ("C3orf28", "FAM162A"),
    ("ERO1L", "ERO1A"),
    ("CYR61", "CCN1"),
    ("CTGF", "CCN2"),
    ("NOV", "CCN3"),
    ("WISP1", "CCN4"),
    ("HIG2", "HILPDA"),
    ("C12orf5", "TIGAR"),
    ("KIAA0101", "PCLAF"),
    ("BHLHB2", "BHLHE40"),
    ("PPAP2B", "PLPP3"),
    ("HN1", "JPT1"),
    ("TCEB1", "ELOC"),
    ("GPR56", "ADGRG1"),
    ("MLLT4", "AFDN"),
    ("WHSC1", "NSD2"),
    ("FAM64A", "PIMREG"),
    ("ADCK3", "COQ8A"),
    ("KIAA1524", "CIP2A"),
    ("GARS", "GARS1"),
    ("ADSS", "ADSS2"),
    ("SEPT9", "SEPTIN9"),
    ("MARCH6", "MARCHF6"),
]


def signatures(spark: SparkSession) -> DataFrame:
    """(signature, gene, gene_pos, coefficient, scoring) of the published signatures."""
    lists = {"prostate20": PROSTATE_20, "ragnum32": RAGNUM_32, "toustrup15": TOUSTRUP_15}
    rows = [
        (name, gene, pos, None, "rowmean")
        for name, genes in lists.items()
        for pos, gene in enumerate(genes.split())
    ]
    rows += [("yang28", gene, pos, c, "weighted") for pos, (gene, c) in enumerate(YANG_28.items())]
    return literal_rows(
        spark, rows, "signature string, gene string, gene_pos int, coefficient double, scoring string"
    )


def verified_signatures(spark: SparkSession) -> DataFrame:
    """The published signatures whose content still matches its pinned checksum."""
    table = signatures(spark)
    pinned = literal_rows(spark, list(CHECKSUMS.items()), "signature string, _pinned string")
    good = signature_checksum(table).join(pinned, "signature").filter(F.col("checksum") == F.col("_pinned"))
    return table.join(good.select("signature", "checksum"), "signature")


def aliases(spark: SparkSession) -> DataFrame:
    """(alias, approved array), aliases upper-cased."""
    rows = literal_rows(spark, ALIASES, "alias string, approved string")
    return rows.groupBy(F.upper("alias").alias("alias")).agg(
        F.array_sort(F.collect_set("approved")).alias("approved")
    )
