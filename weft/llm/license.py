"""Licence scans by canonical digest: a text is a known licence when the whole of it is, up to the matching
guidelines that licence lists publish. Native expressions only.

A text is lower-cased, its title, copyright lines, bullets and numbers of list items go, equivalent spellings and
punctuation are made one, and the SHA-256 of what is left is joined with the digests of known licences. The known
texts pass the same steps; of long ones the digest is all that is kept here. ``folder`` reads more from files.

Edge cases: null, empty and blank texts, and texts of nothing but copyright lines, have no digest and no
licence; repeated rows give repeated rows; a text known under several names gives the first by name;
a null doc_id is kept; very long texts are read whole, and their digest is all that is joined; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as the same, the first made the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("minimise", "minimize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: Short licence texts and notices as their authors publish them.
LICENSES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}

#: Digests of the canonical forms of long licences, from their published text files.
DIGESTS = {
    "Apache-2.0": "04c0200ac913382ffdb30ce8bd4ec57d7ecf6d04ed721c6327bb20a185a3dde0",
    "Artistic-1.0-Perl": "13caa6a0bc52f01d305d07b8139a4750d73ad358309326b68cc4acee2a5d977f",
    "BSD-3-Clause-UC": "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060",
    "CC0-1.0": "fc3b7547cd22a69f533f8dc61ce0b9bba032990bd8d72935ddd5cf7045643f54",
    "GFDL-1.2": "79945d97cd3f05dc0e44d095e4e236ae867104f9b576d0b833d93dd363412510",
    "GFDL-1.3": "651c6a13ab50874bc3b1a070aea150282299661451a89ae4f02059c1a4ba92e0",
    "GPL-1.0": "3d0949be30fac5be641d11e402297c92c3c94ba367af064372116be8ebaa26ed",
    "GPL-2.0": "9aee33fbb708e87a335f7d49de8b1f5184935843856f72cdb670e100842f81fd",
    "GPL-3.0": "3baa41fe0d00ce8c883ceac9993d52b4de7cb300df47c322d4eb3ff6e5ebf46a",
    "LGPL-2.0": "4e184d741443c32929a43660d084feefefdc33b835a8b51d44a0d4e2285c48d9",
    "LGPL-2.1": "3016414fad10c93b8648bc070e7a062e811097281cc4565f514820bec56948cf",
    "LGPL-3.0": "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
    "MPL-1.1": "c5feb5661b09d3a17b6b229cdc0223c17ca4d800272153f21ea071915299711d",
    "MPL-2.0": "fc6db10715dd3f8d6886221817f28e3572f579a7a350ecd43e7cdc6607bf6ba7",
}

#: Words after "copyright" by which a line is a sentence of the licence and no notice.
SENTENCE = "act|and|as|disclaimer|holder|holders|in|interest|interests|is|law|laws|licence|license|licenses|notice|notices|of|on|or|owner|owners|protection|right|rights|statement|statements|term|terms|to|treaties|treaty"
#: A line that is a copyright notice, or says no more than that all rights are reserved.
COPYRIGHT_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n©]*(?:(?:copyright(?![^\p{{L}}\p{{N}}\n]*(?:{SENTENCE})(?![\p{{L}}\p{{N}}]))|\(c\)|©)(?![\p{{L}}\p{{N}}])[^\n]*(?:\n|\z)|all rights reserved[^\p{{L}}\p{{N}}\n]*(?:\n|\z))"
#: What short licences are called in a title line of their own.
TITLED = "0bsd|bsd 2[- ]clause|bsd 3[- ]clause|bsd zero clause|expat|isc|mit|new bsd|simplified bsd|zlib"
TITLE_LINE = rf"\A[^\p{{L}}\p{{N}}\n]*(?:\n[^\p{{L}}\p{{N}}\n]*)*(?:the )?(?:{TITLED})(?: \\?\"[a-z ]+\\?\")?(?: licen[cs]e)?(?: \([a-z0-9 -]+\))?[^\p{{L}}\p{{N}}\n]*\n"
#: The mark of a list item at the start of a line.
ITEM = r"(?m)^[ \t]*(?:\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]|[*•-])[ \t]+"


def canonical(text: Column) -> Column:
    """The text by which licences are compared; empty if nothing is left."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(lowered, TITLE_LINE, ""), COPYRIGHT_LINE, ""), ITEM, "")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return plain


def respelt(plain: Column) -> Column:
    """Equivalent spellings made one, in the few texts that have any."""
    out = plain
    for one, other in SPELLINGS:
        out = F.regexp_replace(out, rf"(?<= ){one}(s?)(?= )", f"{other}$1")
    some = "|".join(one for one, _ in SPELLINGS)
    return F.trim(F.when(plain.rlike(f" (?:{some})s? "), out).otherwise(plain))


def digested(texts: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, n_canonical (characters) and the digest of each text; no digest if nothing is left."""
    plain = texts.select(*keep, canonical(F.col("text")).alias("_plain"))
    done = plain.select(*keep, respelt(F.col("_plain")).alias("_canonical"))
    return done.select(*keep, F.length("_canonical").cast("long").alias("n_canonical"), F.when(F.col("_canonical") != "", F.sha2("_canonical", 256)).alias("digest"))


def known(spark, licenses: dict[str, str] | None = None) -> DataFrame:
    """license and digest of the given texts, or of LICENSES and DIGESTS."""
    rows = spark.createDataFrame(sorted((licenses or LICENSES).items()), "license string, text string")
    return _first_names(digested(rows, "license") if licenses else digested(rows, "license").select("license", "digest").union(spark.createDataFrame(sorted(DIGESTS.items()), "license string, digest string")))


def folder(spark, path: str) -> DataFrame:
    """license (the file's name) and digest of whole text files, for ``scanned``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("license"), F.col("value").alias("text"))
    return _first_names(digested(files, "license"))


def _first_names(rows: DataFrame) -> DataFrame:
    return rows.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, n_canonical, digest, license (null if none) and is_license for each row of docs (doc_id, text).

    licenses (license, digest) may be of any size; the built-in table is broadcast.
    """
    table = F.broadcast(known(docs.sparkSession)) if licenses is None else licenses
    found = digested(docs.select("doc_id", "text"), "doc_id").join(table.select("digest", "license"), "digest", "left")
    return found.select("doc_id", "n_canonical", "digest", "license", F.col("license").isNotNull().alias("is_license"))


def _oracle() -> str:
    """The same steps in DuckDB, whose patterns know no lookaround: spellings go by padded words, twice for neighbours."""
    out = "plain"
    for one, other in SPELLINGS:
        for end in ("", "s"):
            for _ in range(2):
                out = f"replace({out}, ' {one}{end} ', ' {other}{end} ')"
    notice = r"^[^\p{L}\p{N}\n©]*(copyright|\(c\)|©)([^\p{L}\p{N}\n]|$)"
    sentence = rf"^[^\p{{L}}\p{{N}}\n©]*copyright[^\p{{L}}\p{{N}}\n]*({SENTENCE})([^\p{{L}}\p{{N}}]|$)"
    reserved = r"^[^\p{L}\p{N}\n©]*all rights reserved[^\p{L}\p{N}\n]*$"
    title = TITLE_LINE.replace("(?:", "(")
    steps = f"""titled AS (SELECT *, regexp_replace(lower(coalesce(text, '')), '{title}', '') AS t FROM given),
lined AS (SELECT *, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches(x, '{reserved}') OR regexp_matches(x, '{notice}') AND NOT regexp_matches(x, '{sentence}'))), chr(10)) AS l FROM titled),
spaced AS (SELECT *, ' ' || trim(regexp_replace(regexp_replace(l, '{ITEM}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS plain FROM lined),
spelt AS (SELECT *, trim({out}) AS c FROM spaced)"""
    texts = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(LICENSES.items()))
    digests = ", ".join(f"('{k}', '{v}')" for k, v in sorted(DIGESTS.items()))
    return f"""
WITH given AS (SELECT doc_id, text, NULL AS name FROM documents UNION ALL SELECT NULL, text, name FROM (VALUES {texts}) AS t(name, text)),
{steps},
known AS (SELECT digest, min(license) AS license FROM (SELECT sha256(c) AS digest, name AS license FROM spelt WHERE name IS NOT NULL UNION ALL SELECT digest, license FROM (VALUES {digests}) AS d(license, digest)) GROUP BY 1),
found AS (SELECT doc_id, length(c) AS n_canonical, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM spelt WHERE name IS NULL)
SELECT doc_id, n_canonical, digest, license, license IS NOT NULL AS is_license FROM found LEFT JOIN known USING (digest)
"""


ORACLE_SQL = _oracle()
