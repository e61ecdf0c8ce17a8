import pytest
from pyspark.sql import functions as F

from nuntia.llm import licences as lic


def families(spark, *texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    return [(r["doc_id"], r["paragraph"], r["family"]) for r in lic.licence_paragraphs(df).orderBy("doc_id", "paragraph", "window").collect()]


@pytest.mark.parametrize(
    "text,family",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache"), ("Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("# This file is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"), ("licensed under the GNU LESSER General Public License, version 2.1 or later", "lgpl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"), ("dedicated to the public domain under CC0", "cc0"), ("Licensed under CC BY 4.0", "cc-by"),
        ("Copyright 2020 Some One. All rights reserved.", "unknown"), ("a driving licence is required for this permission", "unknown"), ("Licensed under the Frobnicate Licence 7.", "unknown"), ("The professor at MIT said", "unknown"),
    ],
)
def test_families(spark, text, family):
    assert families(spark, text) == [(0, 0, family)]


def test_paragraphs_windows_and_odd_rows(spark, odd, none):
    long = "word " * 500 + "licensed under the GNU General Public License, version 3 " + "word " * 500
    got = families(spark, None, "", "no notice here", f"x\nReleased under the MIT License.\n\nReleased under the MIT License.\n{long}")
    assert {g for g in got if g[2] != "unknown"} == {(3, 1, "mit"), (3, 3, "mit"), (3, 4, "gpl")}
    assert lic.licence_paragraphs(none).collect() == [] and lic.licence_paragraphs(odd).where(F.col("family") != "unknown").count() == 0


@pytest.mark.parametrize(
    "text,line,family",
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", 0, "mit"),
        ("# Copyright (c) 2020 Some One\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n#\n# 1. more", 1, "bsd"),
        ("/*\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n */", 1, "isc"),
        ("it under the terms of the GNU Lesser\nGeneral Public License as published by the Free Software Foundation; either\nversion 2.1 of the License", 0, "lgpl"),
        ("// available under the Creative\n// Commons Attribution 4.0 International", 0, "cc-by"),
    ],
)
def test_wrapped_notices(spark, text, line, family):
    assert {f for f in families(spark, text) if f[2] != "unknown"} == {(0, line, family)}
    apart = [f for f in families(spark, text.replace("\n", "\n\n")) if f[2] == family]
    assert apart == []


def test_glued_versions(spark):
    said = {"Licensed under GPLv3": "gpl", "released under GPLv2+ only": "gpl", "under the LGPLv3 or so": "lgpl", "Licensed under LGPLv2.1": "lgpl", "available under the AGPLv3": "agpl", "Licensed under MPLv2": "mpl", "released under gplv3": "gpl", "Apache2": "unknown", "the GPLfoo of MITv": None}
    assert families(spark, *said) == [(i, 0, f) for i, f in enumerate(said.values()) if f]
    texts = ["GPLv2+ LGPLv2.1 AGPLV3, CC0 v2 ipv6 b2b 3rd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(lic.spoken(F.col("t")).alias("w"))
    assert [r["w"] for r in df.collect()] == [lic.words(t) for t in texts] == [["gpl", "v", "2", "lgpl", "v", "2", "1", "agpl", "v", "3", "cc0", "v", "2", "ip", "v", "6", "b", "2b", "3rd"]]


def test_words_alike_in_python_and_spark(spark):
    texts = ["GNU (L)GPL-2.1+ or later", "  ", "Año 2020: CC BY-SA"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(lic.spoken(F.col("t")).alias("w"))
    assert [r["w"] for r in df.collect()] == [lic.words(t) for t in texts]


def test_held_out_notices_and_calibration():
    import numpy as np

    model = lic.fitted()
    place = {f: i for i, f in enumerate(model.features)}
    right, sure = [], []
    for k, notices in lic.NOTICES.items():
        for n in notices:
            ids = [place[f] for f in lic.features(f"this repository and everything in it are {n} unless noted") if f in place]
            z = model.weights[ids].sum(0) + model.bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            right.append(model.classes[int(z.argmax())] == k)
            sure.append(p.max())
    assert np.mean(right) >= 0.95 and abs(np.mean(right) - np.mean(sure)) < 0.2


def test_query_finds_all_notices_and_is_native(spark, sf_dir, docs):
    fixed = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    want = sorted((r["doc_id"], n, k) for r in docs.collect() for n, line in enumerate((r["text"] or "").split("\n")) for k, s in fixed.items() if s in line)
    df = lic.op5_licences(spark, sf_dir)
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


#: Openings of licence texts and headers as they stand in files. No independent set: some notices that the model learns
#: from were added after these texts had been tried, and share their wording.
IN_FILES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "gpl": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "eupl": 'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");',
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "artistic": "This library is free software; you may redistribute it under the terms of the Artistic License 2.0.",
    "cc-by-nc-nd": "The images of this site are shared under a CC BY-NC-ND 4.0 licence",
    "cc-by-nd": "Creative Commons Attribution-NoDerivatives 4.0 International",
    "bsl": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",
}
NO_NOTICE = (
    "Applicants need a driving licence and permission to work in the city.", "The warranty of the software expires after two years and is limited by copyright law.", "Students of MIT built a boat and sold it to the public.",
    "The Apache web server was restarted twice; a new version is planned.", "A licence fee is paid to the European Commission each year.", "The eclipse was seen in public places all over Mozilla Street.",
    "Redistribution of wealth was debated, with or without modification of the tax law.", "An open font was chosen by the artistic director.", "The GNU project was founded in 1983 as a free foundation for software.",
)


def test_licences_in_files_are_found_wrapped_and_unwrapped(spark):
    import textwrap

    rows = [(f"{k}|{w}|{p}", "\n".join(p + x for x in (textwrap.wrap(t, w) if w else [t]))) for k, t in IN_FILES.items() for w in (None, 72, 60) for p in ("", "# ", " * ")]
    rows += [(f"none|{i}", t) for i, t in enumerate(NO_NOTICE)]
    found = {}
    for r in lic.licence_paragraphs(spark.createDataFrame(rows, "doc_id string, text string")).where("family != 'unknown'").collect():
        found.setdefault(r["doc_id"], set()).add(r["family"])
    known = [k for k, _ in rows if not k.startswith("none")]
    assert sum(k.split("|")[0] in found.get(k, ()) for k in known) >= 0.95 * len(known)
    assert sum(bool(found.get(k, set()) - {k.split("|")[0]}) for k, _ in rows) <= 0.05 * len(rows)
