"""Licence identifiers, alias keys and licence addresses.

The full SPDX list is a table the user supplies (``load_spdx``); the identifiers below are the default for
sessions without one. Alias keys follow from the identifiers by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: common SPDX identifiers (default dictionary) -------------------
CORE_IDS = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0
Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause
BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0
CC-BY-SA-3.0 CC-BY-SA-4.0 CC-PDDC CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 curl ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0
EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG Intel IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later
LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng LPL-1.02 LPPL-1.3c MirOS MIT
MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NAIST-2003 NASA-1.3 NCSA NPL-1.1
ODbL-1.0 ODC-By-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0
Ruby SISSL Sleepycat SMLNJ SPL-1.0 SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet
Zend-2.0 Zlib zlib-acknowledgement ZPL-2.0 ZPL-2.1
""".split()

# --- fixed values: spellings that no rule yields ------------------------------------
CUSTOM_ALIASES = {
    "Apache License Version 2.0": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "Apache 2.0": "Apache-2.0",
    "MIT License": "MIT",
    "BSD 3-Clause License": "BSD-3-Clause",
    "BSD 3-Clause": "BSD-3-Clause",
    "Mozilla Public License 2.0": "MPL-2.0",
    "MPL 2.0": "MPL-2.0",
    "GNU General Public License v3": "GPL-3.0-only",
    "GNU General Public License v3.0": "GPL-3.0-only",
}

# --- fixed values: licence addresses (host without www. and path, lower case, no file extension) ---
URL_LICENSES = {
    "apache.org/licenses/license-2.0": "Apache-2.0",
    "apache.org/licenses": "Apache-2.0",
    "opensource.org/licenses/apache-2.0": "Apache-2.0",
    "opensource.org/licenses/apache2.0": "Apache-2.0",
    "opensource.org/licenses/mit": "MIT",
    "opensource.org/licenses/mit-license": "MIT",
    "opensource.org/licenses/mit-license.php": "MIT",
    "mit-license.org": "MIT",
    "opensource.org/licenses/bsd-2-clause": "BSD-2-Clause",
    "opensource.org/licenses/bsd-3-clause": "BSD-3-Clause",
    "opensource.org/licenses/bsd-license": "BSD-2-Clause",
    "opensource.org/licenses/bsd-license.php": "BSD-2-Clause",
    "gnu.org/licenses/gpl-2.0": "GPL-2.0-only",
    "gnu.org/licenses/gpl-3.0": "GPL-3.0-only",
    "gnu.org/licenses/gpl": "GPL-3.0-only",
    "gnu.org/licenses/lgpl-2.1": "LGPL-2.1-only",
    "gnu.org/licenses/lgpl-3.0": "LGPL-3.0-only",
    "gnu.org/licenses/lgpl": "LGPL-3.0-only",
    "gnu.org/licenses/agpl-3.0": "AGPL-3.0-only",
    "gnu.org/licenses/agpl": "AGPL-3.0-only",
    "gnu.org/licenses/old-licenses/gpl-2.0": "GPL-2.0-only",
    "gnu.org/licenses/old-licenses/lgpl-2.1": "LGPL-2.1-only",
    "opensource.org/licenses/gpl-2.0": "GPL-2.0-only",
    "opensource.org/licenses/gpl-3.0": "GPL-3.0-only",
    "opensource.org/licenses/lgpl-2.1": "LGPL-2.1-only",
    "opensource.org/licenses/lgpl-3.0": "LGPL-3.0-only",
    "opensource.org/licenses/agpl-3.0": "AGPL-3.0-only",
    "mozilla.org/mpl/2.0": "MPL-2.0",
    "mozilla.org/en-us/mpl/2.0": "MPL-2.0",
    "opensource.org/licenses/mpl-2.0": "MPL-2.0",
    "mozilla.org/mpl/1.1": "MPL-1.1",
    "eclipse.org/legal/epl-v10": "EPL-1.0",
    "eclipse.org/legal/epl-1.0": "EPL-1.0",
    "eclipse.org/legal/epl-2.0": "EPL-2.0",
    "opensource.org/licenses/epl-1.0": "EPL-1.0",
    "opensource.org/licenses/epl-2.0": "EPL-2.0",
    "creativecommons.org/publicdomain/zero/1.0": "CC0-1.0",
    "creativecommons.org/licenses/by/4.0": "CC-BY-4.0",
    "creativecommons.org/licenses/by-sa/4.0": "CC-BY-SA-4.0",
    "unlicense.org": "Unlicense",
    "opensource.org/licenses/isc": "ISC",
    "opensource.org/licenses/isc-license": "ISC",
}


def core_spdx(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i,) for i in CORE_IDS], "license_id STRING")


def load_spdx(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers of a published SPDX licence list in JSON."""
    document = spark.read.option("multiLine", True).json(path)
    return document.select(F.explode("licenses").alias("l")).select(F.col("l.licenseId").alias("license_id"))


def alias_key(text: Column) -> Column:
    """Upper case, with runs of spaces and of - _ . / + as one space."""
    return F.btrim(F.upper(F.regexp_replace(text, r"[-_./+ \t\n\r]+", " ")))


def dictionary(spdx: DataFrame) -> DataFrame:
    """(key, license_id) for every spelling: upper-case identifiers first, alias keys where those are free.

    Alias keys are the identifier with separators as spaces and without dashes, and the custom spellings.
    """
    spark = spdx.sparkSession
    exact = spdx.select(F.upper("license_id").alias("key"), "license_id", F.lit(0).alias("rank"))
    custom = spark.createDataFrame(list(CUSTOM_ALIASES.items()), "spelling STRING, license_id STRING").join(
        spdx, "license_id", "left_semi"
    )
    custom = custom.select(alias_key(F.col("spelling")).alias("key"), "license_id", F.lit(1).alias("rank"))
    derived = spdx.select(
        F.explode(F.array(alias_key(F.col("license_id")), alias_key(F.replace("license_id", F.lit("-"), F.lit(""))))).alias("key"),
        "license_id",
        F.lit(2).alias("rank"),
    )
    entries = exact.unionByName(custom).unionByName(derived)
    return entries.groupBy("key").agg(F.min(F.struct("rank", "license_id")).alias("best")).select(
        "key", F.col("best.rank").alias("rank"), "best.license_id"
    )


def url_key(raw: Column) -> Column:
    """Lookup key of a licence address; NULL when it has no host."""
    text = F.btrim(raw)
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(full, parts, 1)), r"^www\.", "")
    path = F.regexp_replace(F.lower(F.regexp_extract(full, parts, 2)), r"/$", "")
    path = F.regexp_replace(path, r"\.(txt|html|htm)$", "")
    return F.when(host != "", F.concat(host, path))


def license_of_url(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in URL_LICENSES.items() for x in pair])
    return F.try_element_at(table, url_key(raw))
