"""Licence scan by sentence rules, with SQL functions only.

A text becomes normalised sentences: comment marks at line starts go, lower case, each run of other
characters than a-z and 0-9 one space. A sentence begins at the start of a line, after a full stop, exclamation
or question mark that white space follows, and after a colon, semicolon, opening bracket or quote. It may
go over wrapped lines, colons, semicolons, brackets and quotes, but not over a full stop or a blank line. The
known licence sentences are looked up at each such place, the longest that fits first; a licence
is a rule on what is left of a text, the identifiers in their order: the rule's must occur in its order, other
known sentences between them or not. A licence whose rule is part of a more special one's is named only
where the special one is not.

A missing or empty text has no sentence and no licence. Repeated rows give repeated results, an empty
table an empty one; columns other than the id and the text are not read. No row leaves its partition.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: licence sentences as they are normalised, by identifier
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "you may not use this file except in compliance with the license",
    3: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    4: "released under the mit license",
    5: "licensed under the mit license",
    6: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    7: "the software is provided as is without warranty of any kind express or implied",
    8: "this work is licensed under the gnu general public license version 3",
    9: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    10: "this program is distributed in the hope that it will be useful but without any warranty",
    11: "this work is licensed under the gnu general public license version 2",
    12: "licensed under cc by nc 4 0",
    13: "licensed under cc by 4 0",
    14: "licensed under cc by sa 4 0",
    15: "this work is licensed under a creative commons attribution 4 0 international license",
    16: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    17: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    18: "redistributions of source code must retain the above copyright notice",
    19: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    20: "this source code form is subject to the terms of the mozilla public license v 2 0",
    21: "all rights reserved",
    22: "spdx license identifier apache 2 0",
    23: "spdx license identifier mit",
    24: "spdx license identifier gpl 3 0 or later",
    25: "spdx license identifier bsd 3 clause",
    26: "licensed under the bsd 3 clause license",
    27: "this is free and unencumbered software released into the public domain",
    28: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    29: "redistributions in binary form must reproduce the above copyright notice",
    30: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    31: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
    32: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    33: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
    34: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license",
    35: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license",
    36: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
    37: "this library is distributed in the hope that it will be useful but without any warranty",
    38: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    39: "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    40: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    41: "the software is provided as is and the author disclaims all warranties with regard to this software",
    42: "this software is provided as is without any express or implied warranty",
    43: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    44: "distributed under the boost software license version 1 0",
    45: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    46: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    47: "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    48: "the person who associated a work with this deed has dedicated the work to the public domain",
    49: "licensed under cc0 1 0",
    50: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    51: "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    52: "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    53: "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    54: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    55: "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
    56: "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    57: "licensed under the european union public licence",
    58: "the contents of this file are subject to the mozilla public license version 1 1",
    59: "licensed under the bsd 2 clause license",
    60: "released under the bsd license",
}
# fixed values: names whose identifier line ("SPDX-License-Identifier: ...") is known beside those above, from 101 on
TAGS = (
    ("Apache-2.0", "apache 2 0 with llvm exception"), ("GPL-2.0", "gpl 2 0"), ("GPL-2.0", "gpl 2 0 only"), ("GPL-2.0", "gpl 2 0 or later"), ("GPL-3.0", "gpl 3 0"), ("GPL-3.0", "gpl 3 0 only"),
    ("LGPL-2.1", "lgpl 2 1"), ("LGPL-2.1", "lgpl 2 1 only"), ("LGPL-2.1", "lgpl 2 1 or later"), ("LGPL-3.0", "lgpl 3 0"), ("LGPL-3.0", "lgpl 3 0 only"), ("LGPL-3.0", "lgpl 3 0 or later"),
    ("AGPL-3.0", "agpl 3 0"), ("AGPL-3.0", "agpl 3 0 only"), ("AGPL-3.0", "agpl 3 0 or later"), ("BSD-2-Clause", "bsd 2 clause"), ("BSD-4-Clause", "bsd 4 clause"), ("0BSD", "0bsd"), ("ISC", "isc"),
    ("MPL-1.1", "mpl 1 1"), ("MPL-2.0", "mpl 2 0"), ("EPL-1.0", "epl 1 0"), ("EPL-2.0", "epl 2 0"), ("EUPL", "eupl 1 2"), ("Zlib", "zlib"), ("BSL-1.0", "bsl 1 0"), ("Unlicense", "unlicense"), ("WTFPL", "wtfpl"),
    ("CC0-1.0", "cc0 1 0"), ("CC-BY-4.0", "cc by 4 0"), ("CC-BY-SA-4.0", "cc by sa 4 0"), ("CC-BY-NC-4.0", "cc by nc 4 0"), ("PostgreSQL", "postgresql"),
)
SENTENCES |= {101 + k: f"spdx license identifier {tag}" for k, (_, tag) in enumerate(TAGS)}
# fixed values: ordered licence rules, a licence and the identifiers that announce it
RULES = (
    ("Apache-2.0", (1,)), ("Apache-2.0", (22,)), ("Apache-2.0", (2, 3)),
    ("MIT", (4,)), ("MIT", (5,)), ("MIT", (23,)), ("MIT", (6, 7)),
    ("GPL-3.0", (8,)), ("GPL-3.0", (24,)), ("GPL", (9, 10)), ("GPL-2.0", (11,)),
    ("CC-BY-NC-4.0", (12,)), ("CC-BY-NC-4.0", (16,)), ("CC-BY-4.0", (13,)), ("CC-BY-4.0", (15,)), ("CC-BY-SA-4.0", (14,)),
    ("BSD-3-Clause", (17, 18, 19)), ("BSD-3-Clause", (25,)), ("BSD-3-Clause", (26,)), ("BSD-2-Clause", (17, 18)),
    ("MPL-2.0", (20,)), ("Unlicense", (27,)), ("Proprietary", (21,)),
    ("GPL-2.0", (31,)), ("GPL-3.0", (32,)), ("LGPL-2.1", (33,)), ("LGPL-3.0", (34,)), ("LGPL-3.0", (35,)), ("AGPL-3.0", (36,)),
    ("BSD-3-Clause", (17, 18, 29, 19)), ("BSD-4-Clause", (17, 18, 29, 30)), ("BSD-2-Clause", (59,)), ("BSD", (60,)),
    ("ISC", (38,)), ("ISC", (39,)), ("0BSD", (40, 41)), ("Zlib", (42, 43)), ("BSL-1.0", (44,)), ("BSL-1.0", (45,)),
    ("EPL-2.0", (46,)), ("EPL-1.0", (47,)), ("CC0-1.0", (48,)), ("CC0-1.0", (49,)), ("CC-BY-SA-4.0", (50,)), ("CC-BY-ND-4.0", (51,)), ("CC-BY-NC-SA-4.0", (52,)), ("CC-BY-NC-ND-4.0", (53,)),
    ("WTFPL", (54,)), ("PostgreSQL", (56,)), ("EUPL", (57,)), ("MPL-1.1", (58,)),
    *((name, (101 + k,)) for k, (name, _) in enumerate(TAGS)),
)
#: Licences whose rule is part of that of a more special one.
SPECIAL = {"BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "BSD-3-Clause": ("BSD-4-Clause",)}
LICENSES = tuple(dict.fromkeys(name for name, _ in RULES))
#: What is done to a lower-case text in turn. " | " ends a sentence, " / " may begin one; "@" stands for the first group.
STEPS = (
    (r"\r\n?", "\n"),
    (r"(^|\n)[ \t]*(?:/\*+|//+|#+|\*+/?|--+|;+|%+|<!--|>+|rem |dnl )[ \t]*", "@"),
    (r"[|/]", " "),
    (r"(^|[^a-z0-9])v\.[ \t\n]+", "@v "),
    (r"[.!?]+[\"')\]]*[ \t\n]+|\n[ \t]*\n", " | "),
    (r"[\n;:(\[\"]", " / "),
    (r"[^a-z0-9|/]+", " "),
    (r"neither the (?:/ )?name of (?:[a-z0-9/]+ ){1,12}?nor the", "neither the name of the copyright holder nor the"),
)
#: Any known sentence where one may begin; between words a line may end.
KNOWN = "[|/] (" + "|".join(s.replace(" ", " (?:/ )*") for s in sorted(SENTENCES.values(), key=lambda s: (-len(s), s))) + ") "


def rule_pattern(ids: tuple[int, ...]) -> str:
    """A pattern over ",1,2,3," that holds if the identifiers come in this order."""
    return "," + ",([0-9]+,)*".join(map(str, ids)) + ","


def any_rule(name: str) -> str:
    return "|".join(rule_pattern(x) for n, x in RULES if n == name)


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    table = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    plain = F.lower(text)
    for pattern, into in STEPS:
        plain = F.regexp_replace(plain, pattern, into.replace("@", "$1"))
    found = F.regexp_extract_all(F.concat(F.lit("| "), plain, F.lit(" ")), F.lit(KNOWN), F.lit(1))
    return F.transform(found, lambda s: F.element_at(table, F.replace(s, F.lit("/ "), F.lit(""))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_sentences`` (known ones), ``sentence_ids`` and ``licenses``, both comma-joined, the latter in the order of the rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array_join(identifiers(text).cast("array<string>"), ",").alias("sentence_ids"))
    ids = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    fits = {name: ids.rlike(any_rule(name)) for name in LICENSES}
    found = F.concat_ws(",", *(F.when(fit & ~reduce(or_, (fits[n] for n in SPECIAL.get(name, ())), F.lit(False)), F.lit(name)) for name, fit in fits.items()))
    some = F.col("sentence_ids") != ""
    return rows.select(
        "doc_id",
        F.when(some, F.size(F.split("sentence_ids", ","))).otherwise(0).cast("bigint").alias("n_sentences"),
        "sentence_ids",
        F.when(some, found).otherwise("").alias("licenses"),
    )


def sql(table: str = "documents") -> str:
    """The same question for DuckDB."""
    names = ", ".join(f"'{s}': {i}" for i, s in SENTENCES.items())

    def fits(name: str) -> str:
        return f"regexp_matches(',' || sentence_ids || ',', '{any_rule(name)}')"

    found = ", ".join(f"CASE WHEN {' AND NOT '.join(map(fits, (name, *SPECIAL.get(name, ()))))} THEN '{name}' END" for name in LICENSES)
    plain = "lower(coalesce(text, ''))"
    for pattern, into in STEPS:
        into = "chr(10)" if into == "\n" else "'" + into.replace("@", r"\1") + "'"
        plain = f"regexp_replace({plain}, '{pattern.replace(chr(39), chr(39) * 2)}', {into}, 'g')"
    return f"""
WITH found AS (
  SELECT doc_id, list_transform(regexp_extract_all('| ' || {plain} || ' ', '{KNOWN}', 1), lambda s: replace(s, '/ ', '')) AS sentences FROM {table}),
known AS (
  SELECT doc_id, array_to_string(list_transform(sentences, lambda s: map_extract(MAP {{{names}}}, s)[1]), ',') AS sentence_ids FROM found)
SELECT doc_id, CASE WHEN sentence_ids = '' THEN 0 ELSE len(string_split(sentence_ids, ',')) END AS n_sentences, sentence_ids,
  CASE WHEN sentence_ids = '' THEN '' ELSE concat_ws(',', {found}) END AS licenses
FROM known"""
