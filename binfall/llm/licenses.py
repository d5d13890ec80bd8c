"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, without copyright lines, equivalent spellings made one, everything but letters and
digits turned into single spaces. The digest of the entire text is then hash-joined to the digests of known licences. As
sources mostly carry a notice in a line of its own, every line of a text is also looked up as an entire text of its own.
The known texts are a table of the user (license_id, text), or else a default one, small enough to broadcast by construction.

Edge cases: null, empty and sign-only texts have the digest of the empty text and no licence; a very long text is looked up whole, and by each of
its lines; a line that occurs repeatedly counts once; rows with a null id keep their notices; repeated rows give repeated, equal
results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "wilfull"),
)
#: Lines that state a copyright, by their first words.
COPYRIGHT = r"(?imd)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)\s|\x{a9})[^\n]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# Entire licence texts and notices, without copyright lines.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_REST),
    ("0BSD", _ISC_GRANT + ". " + _ISC_REST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LicenseRef-Proprietary", "All rights reserved."),
)

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
"""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GFDL-1.2-only",
    "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)
_GNU = (("General Public License", "GPL", ("2", "3")), ("Lesser General Public License", "LGPL", ("2.1", "3")), ("Affero General Public License", "AGPL", ("3",)))
#: Further texts and notices of the default table. The SQL knows ``KNOWN`` alone.
MORE = (
    ("BSD-2-Clause", _BSD_GRANT + _BSD_REST),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_GRANT + _BSD_REST),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_THIRD + _BSD_REST),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_GRANT + _BSD_THIRD + _BSD_REST),
    *((i, f"SPDX-License-Identifier: {i}") for i in _SPDX),
    *((f"{s}-{v if '.' in v else v + '.0'}-{end}", f"This work is licensed under the GNU {name}, version {v}{words}.")
      for name, s, versions in _GNU for v in versions for end, words in (("only", ""), ("or-later", " or any later version"), ("or-later", ", or any later version"))),
)
#: Digests of entire licence texts as their publishers give them.
FULL = (
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Apache-2.0", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3-only", "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0-only", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0-only", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0-only", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("LGPL-2.0-only", "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d"),
    ("LGPL-2.1-only", "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)


def canonical(text: Column) -> Column:
    """The canonical form: equal for texts that differ in case, signs, white space, copyright lines or equivalent spellings."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, " "))
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    has = F.lit(False)
    for odd, _ in SPELLINGS:
        has = has | plain.contains(odd)
    fixed = plain
    for odd, even in SPELLINGS:
        fixed = F.replace(fixed, F.lit(f" {odd} "), F.lit(f" {even} "))
    return F.trim(F.regexp_replace(F.when(has, fixed).otherwise(plain), " +", " "))


def digest(text: Column) -> Column:
    """Digest of the canonical form. It is said not to be null, or a join on it would compute it once more in a filter, part by part."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def known(spark: SparkSession) -> DataFrame:
    """digest and license_id of the default known texts: as many rows as ``KNOWN``, ``MORE`` and ``FULL`` at most."""
    table = spark.createDataFrame([*KNOWN, *MORE], "license_id string, text string")
    return digested(table).unionByName(spark.createDataFrame(list(FULL), "license_id string, digest string")).dropDuplicates(["digest"])


def digested(texts: DataFrame) -> DataFrame:
    """digest and license_id of (license_id, text): of equal texts the least id, none for texts without a letter or digit."""
    named = texts.where("license_id is not null").select(canonical(F.col("text")).alias("form"), "license_id")
    # written down: conditions and joins on a form or digest that is still to be reckoned would reckon it once more each
    named = named.select(F.sha2("form", 256).alias("digest"), (F.col("form") == "").alias("none"), "license_id").checkpoint()
    return named.where("not none").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, text_digest, license_id (of the entire text, else null), notices (ids found in its lines, sorted, comma-joined)
    and n_notices. ``texts`` (license_id, text) are the known texts, if not the default ones."""
    table = F.broadcast(known(docs.sparkSession)) if texts is None else digested(texts)
    d = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"))
    lines = d.select("doc_id", "tkey", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    found = lines.select("doc_id", "tkey", digest(F.col("line")).alias("digest")).join(table, "digest").groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("license_id")).alias("ids"))
    whole = d.select("doc_id", "tkey", digest(F.col("text")).alias("digest")).join(table, "digest", "left")
    # null ids meet too
    found = found.select(F.col("doc_id").alias("its"), F.col("tkey").alias("tk"), "ids")
    both = whole.join(found, F.col("doc_id").eqNullSafe(F.col("its")) & (F.col("tkey") == F.col("tk")), "left")
    return both.select("doc_id", F.col("digest").alias("text_digest"), "license_id", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("notices"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_notices"))
