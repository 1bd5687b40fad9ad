"""Licence scans by canonical digests (operator 3).

A text is made canonical (case, title and copyright lines, list numbers, spellings
that licences use alike, punctuation, white space) with DataFrame functions, then
hashed, and the digest of the entire text is joined to the digests of known
licences.  These come as a table (license_id, text); ``known_texts`` makes one of
KNOWN, the short licences that are kept here, and ``texts_of_files`` one of a folder of
whole texts, such as long licences.

Defined results: a null text has a null digest and no licence; a text without a
letter or digit has the digest of '' and no licence; long texts are read whole;
repeated rows are looked up one by one; if two names share a digest, the first by
name counts; an empty table gives no rows, an empty table of licences no licence;
other columns are passed on, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|:|<|\[|by |[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*"
TITLE = r"^\s*(the )?[a-z0-9][a-z0-9 .,\x22'-]{0,60}licen[cs]e( \([^\n)]{1,40}\))?[ \t]*\r?\n"
NUMBER = r"(^|\n)[ \t]*\(?([0-9]{1,2}|[a-z])[.)][ \t]"
NOT_WORD = r"[^\p{L}\p{N}]+"
# fixed values: spellings that count as the same
ALIKE = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("organisation", "organization"),
    ("favour", "favor"), ("behaviour", "behavior"), ("programme", "program"), ("wilful", "willful"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("https:", "http:"),
]
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
# fixed values: texts and notices of well-known licences (SPDX names)
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. " + _AS_IS,
    "BSD-2-Clause": _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_TWO + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. " + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _AS_IS,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
    "a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
    "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
    "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.\n"
    "For more information, please refer to <https://unlicense.org>",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
    "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
    "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies "
    "or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING "
    "THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


#: Up to so many digests (about 100 bytes each) go to every task; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), TITLE, "\n")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT, "\n"), NUMBER, "\n")
    for other, usual in ALIKE:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def known_texts(spark: SparkSession, texts: dict[str, str] = KNOWN) -> DataFrame:
    """(license_id, text) of the licences that are kept here."""
    return spark.createDataFrame(list(texts.items()), "license_id string, text string")


def texts_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, text) of a folder or pattern of text files, each a whole licence named by its id ('Apache-2.0.txt')."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z]+$", "").alias("license_id"), F.col("value").alias("text"))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan(df: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """``df`` without ``text_col``, with license_digest and license_id, by the licences of ``known`` (license_id, text)."""
    known = known_texts(df.sparkSession) if known is None else known
    found = known.select(digest(F.col("text")).alias("license_digest"), F.col("license_id").cast("string").alias("license_id"))
    found = found.where(F.col("license_digest").isNotNull() & (F.col("license_digest") != F.sha2(F.lit("").cast("binary"), 256)))
    found = materialise(found.groupBy("license_digest").agg(F.min("license_id").alias("license_id")))
    rows = df.withColumn("__digest", digest(F.col(f"`{text_col}`"))).drop("license_digest", "license_id", text_col).withColumnRenamed("__digest", "license_digest")
    few = found.count() <= BROADCAST_DIGESTS
    return rows.join(F.broadcast(found) if few else found, "license_digest", "left")
