"""Invented rows for what the driver's tables do not hold; queries and SQL read the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Rows = list[tuple]

TEXTS: Rows = [
    (1, "id 123-45-6789 and 000-12-3456, not 12-345-6789"),
    (2, "from 2001:db8:0:0:0:0:0:1 to fe80:1:2:3:4:5:6:7, not 2001:db8::1"),
    (3, "Date of birth: 01/02/1990. Signed long after that day, in another town and by another hand, on 2001-02-03"),
    (4, "She was born 5.6.70"),
    (5, "filed on 31-12-2020 with the Registrar of Companies, Maharashtra and RoC again"),
    (6, "the registrar of companies central processing centre wrote"),
    (7, "formerly Blue Fox Foods Limited, now Blue Fox and Daughters Private Limited as of today"),
    (8, "East Hill LLP with North and South Trading Corporation"),
    (9, "at 12 Palm Grove Road, Ashford - 411001 or 7B-9 Old Mill Lane"),
    (10, "Registered Office: 7 North Side, Fairview"),
    (11, "corporate office : 99 Long Quay, Dunmore.\nnext"),
    (12, "near East-Hill Park, Fairview 411001 there and Glenwood, Old Town - 56000"),
    (13, "nothing here"),
]
#: Lines that queries put behind documents, to find in them what the tables lack.
SEEDS = (
    "id 123-45-6789 and 000-12-3456, not 12-345-6789",
    "from 2001:db8:0:0:0:0:0:1 to fe80:1:2:3:4:5:6:7, says the director",
    "Date of birth: 01/02/1990. Signed long after that day, in another town and by another hand, on 2001-02-03",
    "formerly Blue Fox Foods Limited, now Blue Fox and Daughters Private Limited as of today",
    "at 12 Palm Grove Road, Ashford - 411001 or 7B-9 Old Mill Lane",
    "Registered Office: 7 North Side, Fairview",
    "near East-Hill Park, Fairview 411001 there and Glenwood, Old Town - 56000",
    "write to a.b@x.org, phone +1 (555) 010-2345",
    "filed on 31-12-2020 with the Registrar of Companies, Maharashtra and RoC again",
)
SPANS: Rows = [
    (1, "EMAIL", 0, 6, 0.9),
    (1, "EMAIL_ADDRESS", 0, 6, 1.0),
    (2, "COMPANY", 0, 8, 0.9),
    (2, "IP_CANDIDATE", 0, 8, 0.5),
    (3, "ADDRESS", 0, 20, 0.9),
    (3, "EMAIL", 5, 10, 0.5),
    (4, "ADDRESS", 0, 20, 0.9),
    (4, "LOCATION", 5, 10, 0.9),
    (5, "DATE", 0, 10, 0.9),
    (5, "DATE_OF_BIRTH", 0, 10, 0.1),
    (6, "PERSON", 0, 10, 0.9),
    (6, "COMPANY", 5, 15, 0.8),
    (7, "PERSON", 0, 10, 0.8),
    (7, "COMPANY", 5, 15, 0.9),
    (8, "PERSON", 0, 5, 0.8),
    (8, "COMPANY", 5, 15, 0.9),
    (9, "PERSON", 0, 10, 0.9),
    (9, "PERSON", 2, 6, 0.9),
    (9, "EMAIL", 8, 14, 0.9),
    (10, "DATE_OF_BIRTH", 0, 8, 0.9),
    (10, "DATE", 2, 12, 0.9),
    (11, "PHONE", 0, 9, 0.7),
    (11, "ADDRESS", 4, 13, 0.7),
    (12, "ODD", 3, 9, 0.7),
    (12, "PERSON", 3, 9, 0.7),
]
CONTEXTS: Rows = [
    (1, "met Asha Bose there", "PERSON", "Asha Bose"),
    (2, "the Net Proceeds are", "COMPANY", "Net Proceeds"),
    (3, "Contact our Fiscal now", "PERSON", "Fiscal"),
    (4, "Village Road, Sona Nagar 411001", "PERSON", "Sona"),
    (5, "under ISO 555 010 2345", "PHONE", "555 010 2345"),
    (6, "Rs. 555 010 2345 in all", "PHONE", "555 010 2345"),
    (7, "555 010 2345 million", "PHONE", "555 010 2345"),
    (8, "by SEBI itself", "PERSON", "SEBI"),
    (9, "the registrar said", "PERSON", "registrar"),
    (10, "dr registrar said", "PERSON", "registrar"),
    (11, "only offers 555 010 2345", "PHONE", "555 010 2345"),
    (12, "the bank of Elsewhere", "LOCATION", "bank of Elsewhere"),
]
MENTIONS: Rows = [
    (1, 0, 0, "PERSON", "Dr. Asha Bose"),
    (1, 0, 1, "EMAIL", "asha.bose@x.org"),
    (1, 1, 0, "PERSON", "asha  bose"),
    (1, 2, 0, "PERSON", "Bose"),
    (1, 2, 1, "PERSON", "Lars"),
    (1, 3, 0, "EMAIL", "info@x.org"),
    (2, 0, 0, "PERSON", "Mira"),
    (2, 0, 1, "PERSON", "Asha Bose"),
    (2, 0, 2, "PERSON", "Lars Bose"),
    (2, 1, 0, "PERSON", "Bose"),
    (2, 1, 1, "EMAIL", "bose@x.org"),
    (2, 5, 0, "PERSON", "Mira Iyer"),
    (2, 6, 0, "EMAIL", "mira_iyer@x.org"),
    (3, 0, 0, "PERSON", "Reliance"),
    (3, 0, 1, "COMPANY", "Reliance"),
    (3, 1, 0, "EMAIL", "jo.lee@x.org"),
    (3, 2, 0, "PERSON", "Jo Lee"),
    (3, 3, 0, "EMAIL", "JO.LEE@x.org"),
]
COLUMNS = {
    "texts": ("doc_id long, text string", TEXTS),
    "spans": ("doc_id long, entity_type string, start int, end int, confidence double", SPANS),
    "contexts": ("doc_id long, text string, entity_type string, value string", CONTEXTS),
    "mentions": ("doc_id long, block_seq int, ord int, entity_type string, text string", MENTIONS),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = COLUMNS[name]
    return spark.createDataFrame(rows, schema)


def sql(name: str) -> str:
    """A common table expression with the rows."""
    schema, rows = COLUMNS[name]
    names = ", ".join(f'"{c.split(" ")[0]}"' for c in schema.split(", "))

    def value(v: object) -> str:
        return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return f"fixture({names}) AS (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)})"
