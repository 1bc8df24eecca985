"""Survey tables derived from the generic ``customer`` and ``orders`` tables.

Each coded answer is a pseudo-random pick from a list of text codes, made with
integer arithmetic on the row key only, so it costs no shuffle and any engine
computes the same value.  ``households`` is one row per customer; ``persons`` is
one row per order, with the group, stratum and weights of its household.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: "index column: codes"; "a*n" repeats a code, NULL is a missing answer.
HOUSEHOLD_CODES = """
0 HH04: Male, Female*2, NULL
1 HH07: 18, 19, 25, 33, 41, 52, 59, 60, 67, 80, NULL
2 disability_code: 0*3, 1, NULL
3 EDU01_random_code: 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 98, 99, NULL
4 LIGHT01: 1*6, 0, NULL
5 LIGHT02: 1*14, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 96, NULL
6 LIGHT03: 1*3, 2*2, 3, 0, NULL
7 LIGHT05: 1, 0*3, NULL
8 LIGHT05_11: 1, 2, 3, 5, 8, NULL
9 LIGHT05_22: 10, 30, 75, NULL
10 HEA01: 1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 96, 98, NULL
11 HEA03: 5, 10, 15, 20, 30, 40, 45, 60, 61, 90, NULL
12 DWA01: 1, 2, 3, 4, 7, 9, 13, 96, 98, NULL
13 DWA02: 1, 2, 3, NULL
14 DWA03a: 1*3, 2, NULL
15 DWA03b: 1, 2, 10, 20, 30, 31, 45, NULL
16 SHEL01: 1*15, 0, 98, NULL
17 SHEL02: 1*15, 0, 98, NULL
18 SHEL03: 0*15, 1, 98, NULL
19 SHEL04: 0*15, 1, 98, NULL
20 SHEL05: 1*15, 0, 98, NULL
21 SHEL06: 0*15, 1, 98, NULL
22 hh_size_001: 1, 2, 3, 4, 5, 6, 7, 9, NULL
23 DWE05: 1, 2*2, 3*2, 4*2, 5, 0, NULL
24 RISK01: 0*4, 1, NULL
25 RISK02: 0*4, 1, 98, NULL
26 SAF01: 1, 2, 3, 4, 98, 99, NULL
27 GBV01a: 1, 0*2, 98*2, NULL
28 GBV01b: 1, 0*2, 98*2, NULL
29 GBV01c: 1, 0*2, 98*2, NULL
30 GBV01d: 1, 0*2, 98*2, NULL
31 VAW01a: 0*7, 1, 98, 99, NULL
32 VAW01b: 0*7, 1, 98, 99, NULL
33 VAW01c: 0*7, 1, 98, 99, NULL
34 VAW01d: 0*7, 1, 98, 99, NULL
35 VAW01e: 0*7, 1, 98, 99, NULL
36 COOK01: 1*4, 0, NULL
37 COOK02: 1, 2, 3, 4, 5, 6, 7, 8, 9, 10*3, 96, NULL
38 COOK03: 1, 2, 96, NULL
39 DWE08: 1*2, 0, NULL
40 DWE09: 1, 2, 3, 4, 98, NULL
41 BIR01: 1*2, 0, NULL
42 BIR02: 1, 0, NULL
43 BIR03: 1, 2, 3, 4, 5, 6, 96, 98, NULL
44 TOI01: 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 96, NULL
45 TOI02: 1*2, 2, 98, NULL
46 TOI03: 1, 2, 3, 4, 5, 96, 98, NULL
47 TOI05: 0, 1, NULL
48 BANK01: 0*4, 1, 98, NULL
49 BANK02: 0*4, 1, 98, NULL
50 BANK03: 0*4, 1, 98, NULL
51 BANK04: 0*4, 1, 98, NULL
52 BANK05: 0*4, 1, 98, NULL
53 INC01: 1, 2, 3, NULL
54 INC02: 1, 2, 3, NULL
55 UNEM01: 0*3, 1, NULL
56 UNEM02: 0*3, 1, NULL
57 UNEM03: 0*3, 1, NULL
58 UNEM04: 0*3, 1, NULL
59 UNEM05: 0*3, 1, NULL
60 UNEM06: 1, 2, 3, NULL
61 UNEM07: 1, 2, 3, NULL
62 UNEM08: 1, 2, 3, 4, NULL
63 UNEM09: 1*2, 0, NULL
64 UNEM10: 1*2, 0, NULL
65 DWE06a_land: 1*2, 0, 98, NULL
66 DWE06a_housing: 1*2, 0, 98, NULL
67 DWE10: 1, 2, 3, 4, 98, 99, NULL
68 SPF01a: 0*9, 1, 98, NULL
69 SPF01b: 0*9, 1, 98, NULL
70 SPF01c: 0*9, 1, 98, NULL
71 SPF01d: 0*9, 1, 98, NULL
72 SPF01e: 0*9, 1, 98, NULL
73 SPF01f: 0*9, 1, 98, NULL
74 SPF01g: 0*9, 1, 98, NULL
75 SPF01h: 0*9, 1, 98, NULL
76 SPF01j: 0*9, 1, 98, NULL
77 SPF01k: 0*9, 1, 98, NULL
78 SPF01l: 0*9, 1, 98, NULL
79 SPF01m: 0*9, 1, 98, NULL
80 SPF01n: 0*9, 1, 98, NULL
81 SPF01o: 0*9, 1, 98, NULL
82 SPF01p: 0*9, 1, 98, NULL
"""

PERSON_CODES = """
200 HH04: Male, Female*2, 3, 99, NULL
201 HH07: 0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 13, 14, 16, 17, 18, 19, 30, 45, 60, 75, NULL
202 disability_code: 0*3, 1, NULL
203 HACC01: 1*3, 0, NULL
204 HACC03: 1*2, 0*2, NULL
205 HACC04_1: 0*6, 1, NULL
206 HACC04_2: 0*6, 1, NULL
207 HACC04_3: 0*6, 1, NULL
208 HACC04_4: 0*6, 1, NULL
209 HACC04_5: 0*6, 1, NULL
210 HACC04_6: 0*6, 1, NULL
211 HACC04_7: 0*6, 1, NULL
212 HACC04_8: 0*6, 1, NULL
213 HACC04_9: 0*6, 1, NULL
214 HACC04_10: 0*6, 1, NULL
215 HACC04_11: 0*6, 1, NULL
216 HACC04_12: 0*6, 1, NULL
217 HACC04_13: 0*6, 1, NULL
218 HACC04_96: 0*6, 1, NULL
219 EDU01: 1*3, 0, NULL
220 EDU02: 1*3, 0, NULL
221 EDU03: 1, 2*2, 3, 4, 5, NULL
222 REG01a: 0*7, 1, 98, NULL
223 REG01b: 0*7, 1, 98, NULL
224 REG01c: 0*7, 1, 98, NULL
225 REG01d: 0*7, 1, 98, NULL
226 REG01e: 0*7, 1, 98, NULL
227 REG01f: 0*7, 1, 98, NULL
228 REG01g: 0*7, 1, 98, NULL
229 REG02: 0*5, 1, 98, NULL
230 REG03: 0*2, 1, 98, NULL
231 REG04: 0*2, 1, 98, 99, NULL
232 REG05a: 0*7, 1, 98, NULL
233 REG05b: 0*7, 1, 98, NULL
234 REG05c: 0*7, 1, 98, NULL
235 REG05d: 0*7, 1, 98, NULL
236 REG05e: 0*7, 1, 98, NULL
237 REG05f: 0*7, 1, 98, NULL
238 REG06: 0*5, 1, 98, NULL
239 COMM01: 1*3, 0, NULL
240 COMM02: 0, 1, 2, 3, 4, 98, NULL
241 COMM03: 1*4, 0, 98, NULL
242 COMM04: 1*4, 0, 98, NULL
243 MMR03: 1*2, 0, 98, NULL
"""


def code_lists(text: str) -> list[tuple[int, str, list[str | None]]]:
    """Index, column and expanded code list of every line."""
    out = []
    for line in text.strip().splitlines():
        head, codes = line.split(": ")
        index, name = head.split()
        values: list[str | None] = []
        for item in codes.split(", "):
            code, _, times = item.partition("*")
            values += [None if code == "NULL" else code] * int(times or 1)
        out.append((int(index), name, values))
    return out


def _pick(key: str, index: int, values: list[str | None]) -> str:
    choices = ", ".join("CAST(NULL AS STRING)" if v is None else f"'{v}'" for v in values)
    spread = f"({key} * {7919 + 1994 * index}L + {104729 + 31 * index}L) % 1000003L"
    return f"get(array({choices}), CAST({spread} % {len(values)} AS INT))"


def _coded(key: str, text: str) -> dict[str, str]:
    return {name: _pick(key, index, values) for index, name, values in code_lists(text)}


def _citizenship(key: str) -> str:
    return f"get(array('SDN', 'XXX', 'SSD', CAST(NULL AS STRING)), CAST({key} % 4 AS INT))"


def _age_band(age: str) -> str:
    years = f"try_cast({age} AS INT)"
    return (
        f"CASE WHEN {years} < 5 THEN 'Under 5' WHEN {years} <= 17 THEN '5-17' "
        f"WHEN {years} <= 59 THEN '18-59' WHEN {years} > 59 THEN '60+' END"
    )


# Group, stratum and the two weights shared by a household and its members.
_SAMPLING = {
    "pop_groups": "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') THEN 'IDPs'"
    " WHEN c_mktsegment = 'FURNITURE' THEN 'Refugee returnees' END",
    "samp_strat": "concat('S', CAST(c_nationkey % 5 AS STRING))",
    "wgh_samp_pop_restr": "0.5D + (c_custkey % 7) * 0.25D",
    "wgh_strata_spec": "1.0D + (c_nationkey % 5) * 0.5D",
}


def _select(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return frame.selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household table: keys, design columns and text answer codes."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    coded = _coded("c_custkey", HOUSEHOLD_CODES)
    columns = {
        "hh_id": "c_custkey",
        **_SAMPLING,
        "wgh_strata_spec_resp": "1.0D + (c_custkey % 3) * 0.5D",
        "wgh_samp_pop_restr_resp": "0.25D + (c_custkey % 11) * 0.125D",
        "citizenship": _citizenship("c_custkey"),
        **coded,
        "HH07_cat": _age_band(coded["HH07"]),
    }
    return _select(customer, columns)


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person table: household link, design columns and text answer codes."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sampled = orders.join(customer, orders.o_custkey == customer.c_custkey)
    coded = _coded("o_orderkey", PERSON_CODES)
    age = f"try_cast({coded['HH07']} AS INT)"
    columns = {
        "person_id": "o_orderkey",
        "hh_id": "o_custkey",
        **_SAMPLING,
        "citizenship": _citizenship("o_orderkey"),
        **coded,
        "HH07_cat": _age_band(coded["HH07"]),
        "HH07_cat2": f"CASE WHEN {age} < 18 THEN '0-17' WHEN {age} >= 18 THEN '18+' END",
    }
    columns["disability_code"] = (
        f"CASE WHEN {age} < 5 AND o_orderkey % 3 <> 0 THEN NULL ELSE {coded['disability_code']} END"
    )
    return _select(sampled, columns)
