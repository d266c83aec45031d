"""License scans by canonical digest: a text is looked up as a whole, its lines one by one.

Case, punctuation, copyright lines, white space and equivalent spellings don't count. What is
left is digested and joined to the digests of known licences and notices, a table of fixed and
small size that is broadcast. Everything is column expressions, and texts don't move.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty

# Equivalent spellings, each to the first form's.
SPELLINGS = {
    "licence": "license", "organisation": "organization", "colour": "color", "favour": "favor",
    "behaviour": "behavior", "honour": "honor", "labour": "labor", "judgement": "judgment",
    "acknowledgement": "acknowledgment", "centre": "center", "catalogue": "catalog", "cancelled": "canceled",
    "recognise": "recognize", "authorise": "authorize", "initialise": "initialize", "utilise": "utilize",
    "artefact": "artifact", "fulfilment": "fulfillment", "per cent": "percent", "https": "http",
    "copyright owner": "copyright holder", "non commercial": "noncommercial",
}

# Licence texts and notices by SPDX identifier.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. " + _WARRANTY)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. ")
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. ")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
LICENSES = [
    ("MIT", _MIT), ("MIT", "MIT License " + _MIT), ("MIT", "The MIT License (MIT) " + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_START + _BSD_NAME + _BSD_END),
]
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
# Canonical digests of long licences as published, and of their terms alone
# (up to "END OF TERMS AND CONDITIONS") where they close with directions for use.
LONG_LICENSES = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
]
NOTICE_WORD = "licens"  # every notice has it, so other lines needn't be digested
# A copyright line, behind comment marks too: its word, then a sign, a year or a name's place. It ends with its
# line or with the reservation of rights, as a licence may follow on the same line.
COPYRIGHT = (r"(?m)^[ \t#*/;%!<>-]*(?:(?:(?:copyright|\(c\)|©)[ \t:]*(?:copyright|\(c\)|©|[0-9]{4}|[<\[{]|by )"
             r"|copyright [^\n]{0,60}?(?:19|20)[0-9]{2})(?:[^\n]*?all rights reserved\.?|[^\n]*)|all rights reserved\.?)")
COPYRIGHT_WORD = r"copyright|\(c\)|©|all rights"
PUNCTUATION = r"[!-/:-@\[-`{-~“”‘’«»–—…·•®™©]+"
BLANK = r"[ \t\x0B\f]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_text(text: str) -> str:
    """What counts of a text, in plain Python: used for the known texts."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(str.maketrans(UPPER, LOWER))
    text = re.sub(BLANK, " ", re.sub(PUNCTUATION, " ", re.sub(COPYRIGHT, "", text)))
    for other, form in SPELLINGS.items():
        text = text.replace(other, form)
    return re.sub(r"[ \n]+", " ", text).strip(" ")


def canonical_lines(text: Column) -> Column:
    """What counts of a text, line by line."""
    text = F.translate(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), UPPER, LOWER)
    text = F.when(text.rlike(COPYRIGHT_WORD), F.regexp_replace(text, COPYRIGHT.replace("(?m)", "(?md)"), "")).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " "), BLANK, " ")
    for other, form in SPELLINGS.items():
        text = F.replace(text, F.lit(other), F.lit(form))
    return text


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def _known() -> dict[str, str]:
    return {digest(text): name for name, text in LICENSES + NOTICES} | {d: name for name, d in LONG_LICENSES}


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(_known().items()), "text_sha256 string, license string")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256 (of the canonical text), license (that the
    whole text is, or null), notices (licences named by whole lines, in order, comma-joined),
    n_notices. A null or empty text has the digest of the empty one and no licence; rows,
    repeated ones too, stay; other columns are not looked at."""
    lines = docs.select("doc_id", canonical_lines(text_or_empty()).alias("lines"))
    names = F.create_map(*[F.lit(v) for name, text in NOTICES for v in (digest(text), name)])
    hits = F.filter(F.transform(F.filter(F.split("lines", "\n"), lambda x: F.contains(x, F.lit(NOTICE_WORD))),
                                lambda x: F.try_element_at(names, F.sha2(F.trim(x).cast("binary"), 256))),
                    lambda x: x.isNotNull())
    whole = F.trim(F.regexp_replace("lines", r"[ \n]+", " "))
    marked = lines.select("doc_id", F.sha2(whole.cast("binary"), 256).alias("text_sha256"), hits.alias("hits"))
    return marked.join(F.broadcast(known(docs.sparkSession)), "text_sha256", "left").select(
        "doc_id", "text_sha256", "license", F.array_join("hits", ",").alias("notices"),
        F.size("hits").alias("n_notices"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    text = f"translate({text}, '{UPPER}', '{LOWER}')"
    for pattern, by in ((COPYRIGHT, ""), (PUNCTUATION, " "), (BLANK, " ")):
        text = f"regexp_replace({text}, {quote(pattern)}, '{by}', 'g')"
    for other, form in SPELLINGS.items():
        text = f"replace({text}, '{other}', '{form}')"
    known_rows = ", ".join(f"('{d}', '{n}')" for d, n in _known().items())
    notice_rows = ", ".join(f"('{d}', '{n}')" for d, n in {digest(t): n for n, t in NOTICES}.items())
    return f"""
WITH known(d, license) AS (VALUES {known_rows}), notice(d, name) AS (VALUES {notice_rows}),
m AS (SELECT map(list(d), list(name)) AS names FROM notice),
canon AS (SELECT doc_id, {text} AS lines FROM documents),
marked AS (SELECT doc_id, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))) AS text_sha256,
    list_filter(list_transform(string_split(lines, chr(10)), lambda x: names[sha256(trim(x))]), lambda x: x IS NOT NULL) AS hits
  FROM canon, m)
SELECT doc_id, text_sha256, license, array_to_string(hits, ',') AS notices, CAST(len(hits) AS INTEGER) AS n_notices
FROM marked LEFT JOIN known ON d = text_sha256
"""


SQL = _sql()
