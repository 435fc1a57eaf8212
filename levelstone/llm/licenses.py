"""Licence scans by canonical digest: DataFrame functions alone, and a hash join with the known digests.

A text is made canonical: lower case, copyright lines out, equivalent spellings made one, everything but letters and
digits a space, spaces squeezed. What is left is digested whole and joined with the digests of known licences. The same
is done for every line of a text, since a notice ("Released under the ... License.") is a text of its own in a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

# Spellings that mean the same, applied in this order to lower-case text. Rules of endings also meet words
# that have one spelling; these change alike in every text.
EQUIVALENT = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("&", " and "),
    ("https://", "http://"),
    ("practise", "practice"),
    ("programme", "program"),
    ("artefact", "artifact"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("offence", "offense"),
    ("fulfill", "fulfil"),
    ("centre", "center"),
    ("dgement", "dgment"),
    ("isation", "ization"),
    ("ising", "izing"),
    ("ise", "ize"),
    ("yse", "yze"),
    ("our", "or"),
    ("ogue", "og"),
    ("elled", "eled"),
    ("elling", "eling"),
)
#: Words after "copyright" in the body of a licence, whose lines may begin with it; anything else there is a name.
BODY_WORDS = "notices? holders? owners? licen[cs]e[sd]? laws? interests? rights? protections? treaty treaties act statements? status permissions? ownership infringements? disclaimers? terms? on in of or and is are to that which this for from as at under with shall may does has if where".split()
#: Notices, after any comment marks: copyright and a sign, a year or a name; a sign and a year; a reservation of rights.
COPYRIGHT_LINE = (
    r"(?md)^[^\p{L}\p{N}\n©(]*(?:(?:portions[ \t]+)?copyright(?:[ \t]*(?:\(c\)|©|&copy;|:|,?[ \t]*[<\[{]?\d{4})|[ \t]+(?!(?:"
    + "|".join(BODY_WORDS)
    + r")\b)[\p{L}<\[{])|\(c\)[ \t]*(?:copyright|\d{4})|©|all rights reserved)[^\n]*$"
)
#: Names under which licences are referred to.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
}
#: Titles of whole licences that have no notices here.
TITLES = {"MIT-0": ("MIT No Attribution",), "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",)}
NOTICES = ("Released under the {}", "Released under {}", "Licensed under the {}", "Licensed under {}", "This work is licensed under the {}", "This work is licensed under {}", "Distributed under the {}", "SPDX-License-Identifier: {}", "License: {}")
#: Whole licences, in their published wording.
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
#: Whole licences that the SQL of the query doesn't hold.
MORE_TEXTS = {
    "BSD-2-Clause": (_BSD[:3], _BSD[4:]),
    "BSD-3-Clause": (_BSD[:4], _BSD[4:]),
    "MIT-0": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        'The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "Unlicense": (
        'This is free and unencumbered software released into the public domain.',
        'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
        'In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'For more information, please refer to <http://unlicense.org/>',
    ),
}
#: Canonical digests of longer licences as published, with and without their appendix.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("50e1d5338c2c42b663c3fac0bc6a8967", "819af0a480f50492ffe44eafbf182b09", "3e4fa086bb91dd583d8d751195b91bb3"),
    "GPL-1.0": ("039f5affadd410e782b7f2ebea3b11f3", "d54db6ff1e83a0c065a3553955a86941", "8ad615f420ea4f07e94a5236b0c01f8b"),
    "GPL-2.0": ("ae45f31bd111cbc3541cb4a1cf209ad2", "5f731dfe1fc525f3e0e5352abf2f78dd", "4434c055a8217c7afbf9e21c55253575"),
    "GPL-3.0": ("eb622f7258dfb2d0dd1d099c941d3dae", "0b2f368a104e9810517876ddecfa28a2", "b600c3da5652879090f8055db7871e2a"),
    "LGPL-2.0": ("2502b7c9cff1c750a56257ed8f3531e4", "beec3b21fb96d37235311c6170698807", "c62109dccf88e7db8101ee5895c6b94a"),
    "LGPL-2.1": ("5a43736f73b55639d3f6a0205338f29a", "b56c9ae8d074ba49d4be1baae53b30b9", "3353ffcdcbc3c3403b7c3bbb4e627121"),
    "LGPL-3.0": ("d778e9f82dc6308ebab34894943a3c3c",),
    "MPL-1.1": ("2dd27207749a4d601b1699b84bedb715",),
    "MPL-2.0": ("8ea9c1a128d0f053e5672e6458a1aefd",),
    "CC0-1.0": ("1d015b476c495ce9fd3c17ca84d87272",),
    "GFDL-1.2": ("305132a26137dacffc5f3333ed9194e4", "ede4dcb965ba933aef7ec1ecd752f800"),
    "GFDL-1.3": ("5bbcc3f4f4225b2b1437b44633fc1432", "5b290f25bd7f4bde5596e7bb95f82797"),
    "Artistic-1.0": ("60bd2676ac850a1ed078c628b11fda2c",),
}
#: Known digests are a list of licences, not of data; more than this many are joined without a broadcast.
BROADCAST_LICENSES = 100_000


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of every whole licence, with and without its title, and of every notice."""
    notices = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    titled = [(k, f"{NAMES[k][0] if k in NAMES else k}\n\n{t}") for k, t in TEXTS.items()]
    return sorted({*notices, *titled, *TEXTS.items()})


def more_texts() -> list[tuple[str, str]]:
    """(licence, text) of MORE_TEXTS, with and without title, clauses numbered or not."""
    out = []
    for k, parts in MORE_TEXTS.items():
        if not k.startswith("BSD"):
            bodies = ["\n".join(parts)]
        else:
            (first, *clauses), rest = parts
            bodies = ["\n".join([first, *(f"{i}. {c}" if numbered else c for i, c in enumerate(clauses, 1)), *rest]) for numbered in (True, False)]
        out += [(k, b) for b in bodies] + [(k, f"{title}\n{b}") for title in TITLES.get(k) or NAMES[k][:1] for b in bodies]
    return out


def canonical(text: Column) -> Column:
    """Canonical text with its line breaks: a line is a run of words parted by single spaces."""
    c = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for a, b in EQUIVALENT:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(c, r" ?\n ?", "\n")


def _whole(c: Column) -> Column:
    c = F.trim(F.translate(F.regexp_replace(c, r"\n+", " "), "\n", " "))
    for a, b in EQUIVALENT:  # spellings of two words, wherever lines were broken
        c = F.replace(c, F.lit(a), F.lit(b)) if " " in a else c
    return c


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id); of licences with one canonical text, the first by name."""
    pairs = [F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in ([*known_texts(), *more_texts()] if licenses is None else licenses)]
    rows = spark.range(1).select(F.inline(F.array(*pairs) if pairs else F.expr("cast(array() as array<struct<license_id: string, text: string>>)")))
    digests = rows.select("license_id", F.md5(_whole(canonical(F.col("text")))).alias("digest"))
    if licenses is None and DIGESTS:
        published = [F.struct(F.lit(k).alias("license_id"), F.lit(d).alias("digest")) for k, v in DIGESTS.items() for d in v]
        digests = digests.unionByName(spark.range(1).select(F.inline(F.array(*published))))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, licenses: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each different doc_id of ``docs``, null among them: doc_id, digest, license_id, n_license_lines, line_licenses.

    ``license_id`` is the licence that the whole text is, else null. ``n_license_lines`` counts lines that are a known
    licence or notice; ``line_licenses`` names them, distinct, in order and joined by commas, empty if there is none.
    Null and empty texts have the digest of the empty text and no licence. Rows of one doc_id, repeated or not, make one
    row: the least digest, the least licence, all their lines; so do rows with a null doc_id. Of licences with one
    canonical text, the first by name counts. Texts and lines of any length are taken whole. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    known = known_digests(spark, licenses)
    if len(licenses if licenses is not None else known_texts()) <= BROADCAST_LICENSES:
        known = F.broadcast(known)
    c = canonical(text_of(docs, text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), c.alias("c"))
    whole = F.struct(F.lit(-1).alias("line"), F.md5(_whole(F.col("c"))).alias("digest"))
    lines = F.transform(F.split("c", "\n"), lambda x, i: F.struct(i.alias("line"), F.md5(F.trim(x)).alias("digest")))
    # a line without words is no licence; the whole text stands at line -1
    units = rows.select("doc_id", F.explode(F.concat(F.array(whole), lines)).alias("u")).select("doc_id", "u.line", "u.digest")
    found = units.join(known, "digest", "left")
    here = F.col("line") == -1
    named = F.sort_array(F.collect_set(F.when(~here, F.col("license_id"))))
    out = found.groupBy("doc_id").agg(F.min(F.when(here, F.col("digest"))).alias("digest"), F.min(F.when(here, F.col("license_id"))).alias("license_id"), F.count_if(~here & F.col("license_id").isNotNull()).alias("n_license_lines"), named.alias("named"))
    return out.select("doc_id", "digest", "license_id", "n_license_lines", F.array_join("named", ",").alias("line_licenses"))
