"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: capitals to small letters, lines that state a copyright dropped, equivalent
spellings made one, everything but letters and digits to single spaces. The SHA-256 of the canonical form of the entire
text is hash-joined to the digests of the known licences; that of every line is looked up
among the digests of known notices, which are one line each. Both lists are fixed and small.

Edge cases: a null or empty text, or one of punctuation and copyright lines only, matches nothing and has the digest of the
empty string; several notices are listed once each, sorted; repeated rows are each answered; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import table

# A line that states a copyright: the word, perhaps after "portions" or "parts", with a sign or a name or a year after it; or a sign of its own.
COPYRIGHT = r"(^|\n)[ \t#*/;-]*(?:(?:some[ \t]+)?(?:portions[ \t]+|parts[ \t]+)?(?:copyright(?:[ \t:,]*(?:\(c\)|©)|[ \t:,]+[^ \t\n])|\(c\)[^\n]*?(?:19|20)[0-9][0-9]|©)|all rights reserved)[^\n]*"
# What goes on with the word in running text, where a wrapped line may begin with it; fixed values.
RUNNING = r"copyright[ \t]+(holders?|owners?|notices?|laws?|interests?|licenses?|statements?|protections?|rights?|infringements?|terms?|status|permissions?|and|or|in|of|on|to|is|are|was)([^a-z0-9]|$)"
# Spellings that count as one; fixed values.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"), ("authorised", "authorized"), ("authorisation", "authorization"), ("favour", "favor"),
    ("judgement", "judgment"), ("whilst", "while"), ("https:", "http:"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n"
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    f"{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN '
    "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# The texts of known licences, without their titles and copyright lines; fixed values.
LICENCES = {
    "MIT": _MIT,
    "BSD-2-Clause": _BSD_2 + _BSD_TAIL,
    "BSD-3-Clause": _BSD_2 + _BSD_3 + _BSD_TAIL,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL,
}
LICENCES |= {
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We "
        "make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
        f"{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
        "For more information, please refer to <https://unlicense.org>"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
LICENCES |= {
    "MIT-0": _MIT.replace(", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n", ".\n"),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, '
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following:\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in "
        "whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
        f"{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    # The notices that the longer licences ask to be put into each file.
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n'
        "http://www.apache.org/licenses/LICENSE-2.0\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
for _name, _title, _what, _version in (
    ("GPL-3.0-or-later", "GNU General Public License", "program", "version 3"), ("GPL-2.0-or-later", "GNU General Public License", "program", "version 2"),
    ("AGPL-3.0-or-later", "GNU Affero General Public License", "program", "version 3"), ("LGPL-3.0-or-later", "GNU Lesser General Public License", "library", "version 3"),
    ("LGPL-2.1-or-later", "GNU Lesser General Public License", "library", "version 2.1"),
):
    LICENCES[_name] = (
        f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the {_title} as published by the Free Software Foundation, either {_version} of the License, or (at your "
        f"option) any later version.\nThis {_what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the {_title} for more details.\nYou should have received a copy of the {_title} along with this {_what}. If not, see <https://www.gnu.org/licenses/>."
    )
# Titles that may stand before a text; fixed values.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "Zlib": ["zlib License", "The zlib/libpng License"], "Unlicense": ["The Unlicense"], "MIT-0": ["MIT No Attribution"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}
#: (licence, text) for each text as it is and after each of its titles.
KNOWN = [(name, title + text) for name, text in LICENCES.items() for title in ["", *(t + "\n" for t in TITLES.get(name, []))]]
# SHA-256 of the canonical forms of whole licences as they are published, with their line breaks, and of their terms up to "END OF TERMS AND CONDITIONS"
# where an appendix follows; made once from the copies in the folder /usr/share/common-licenses of Debian's base-files; fixed values.
DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"), ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"), ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"), ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"), ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"), ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"), ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"), ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"), ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"), ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]
# One-line notices and the licence they name; fixed values.
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]


def _lines_kept(text: Column) -> Column:
    """The canonical form but for line ends, which are kept."""
    x = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.regexp_replace(x, RUNNING, "copyright_$1$2"), COPYRIGHT, "$1")
    return F.regexp_replace(x, r"[^a-z0-9\n]+", " ")


def _entire(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    return _entire(_lines_kept(text))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", licences: list[tuple[str, str]] | DataFrame | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, text_digest, license, notices) for every row: the licence that is the entire text, or null, and the licences that whole lines name.

    licences may be a table (license, known_text) of any size, such as a collection of further texts; the built-in list, with the digests of the long licences, is short and broadcast.
    """
    spark = docs.sparkSession
    given = isinstance(licences, DataFrame)
    known = licences.select("license", "known_text") if given else spark.createDataFrame(licences or KNOWN, "license string, known_text string")
    known = known.select("license", F.sha2(canonical(F.col("known_text")), 256).alias("text_digest"))
    if licences is None:
        known = known.union(spark.createDataFrame(DIGESTS, "license string, text_digest string"))
    known = known.groupBy("text_digest").agg(F.min("license").alias("license"))
    listed = notices or NOTICES
    # One pass over a text: its lines are looked up in a small constant map of notice digests, and only the digest of the whole goes on to the join.
    named = F.map_from_entries(F.array(*[F.struct(F.sha2(canonical(F.lit(line)), 256), F.lit(name)) for line, name in sorted({_key(line): (line, name) for name, line in reversed(listed)}.values())]))
    rows = docs.select(F.col(id_col).alias("doc_id"), _lines_kept(F.col(text_col)).alias("lines"))
    found = F.transform(F.split("lines", "\n"), lambda x: F.try_element_at(named, F.sha2(F.trim(x), 256)))
    rows = rows.select("doc_id", F.sha2(_entire(F.col("lines")), 256).alias("text_digest"), F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",").alias("notices"))
    return rows.join(known if given else F.broadcast(known), "text_digest", "left").select("doc_id", "text_digest", "license", "notices")


def _key(line: str) -> str:
    """Notices that have the same words count as one; the first in the list names it."""
    return "".join(c for c in line.lower() if c.isalnum())


def op5_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_lines(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    for a, b in SPELLINGS:
        x = f"replace({x}, {_sql_text(a)}, {_sql_text(b)})"
    x = f"regexp_replace(regexp_replace({x}, '{RUNNING}', 'copyright_\\1\\2', 'g'), '{COPYRIGHT}', '\\1', 'g')"
    return f"regexp_replace({x}, '[^a-z0-9\\n]+', ' ', 'g')"


def _sql_entire(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"


ORACLE_SQL = f"""
WITH digest AS (SELECT sha256({_sql_entire(_sql_lines("t"))}) AS text_digest, l FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in KNOWN)}) v(l, t)
  UNION ALL SELECT text_digest, l FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in DIGESTS)}) v(l, text_digest)),
known AS (SELECT text_digest, min(l) AS license FROM digest GROUP BY text_digest),
notice AS (SELECT DISTINCT sha256({_sql_entire(_sql_lines("t"))}) AS line_digest, l AS named FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in NOTICES)}) v(l, t)),
rows AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
digests AS (SELECT doc_id, sha256({_sql_entire("lines")}) AS text_digest, lines FROM rows),
found AS (SELECT doc_id, text_digest, string_agg(named, ',' ORDER BY named) AS notices FROM (
  SELECT DISTINCT doc_id, text_digest, named FROM (SELECT doc_id, text_digest, sha256(trim(unnest(string_split(lines, chr(10))))) AS line_digest FROM digests) JOIN notice USING (line_digest)) GROUP BY ALL)
SELECT d.doc_id, d.text_digest, license, coalesce(notices, '') AS notices FROM digests d LEFT JOIN known USING (text_digest) LEFT JOIN found USING (doc_id, text_digest)
"""
