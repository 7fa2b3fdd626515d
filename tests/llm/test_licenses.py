import re

import duckdb

from tessera.llm import licenses
from tessera.llm.queries import op9_license_scan


def test_known_texts_in_other_dress(spark):
    known = licenses.texts()
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSD-3-Clause", "BSD-4-Clause"} <= {k for k, _ in known}
    rows = list(known)
    rows += [(k, "Copyright (c) 2020 A. Person\n# All rights reserved.\n\n" + text.upper().replace(", ", " , ").replace("\n", "\r\n // ")) for k, text in known]
    rows += [(k, re.sub(r"\blicense\b", "licence", text).replace("Licensed", "LICENCED").replace("http:", "https:").replace("copyright holder", "Copyright Owner")) for k, text in known]
    by_name = dict(reversed(known))
    rows.append(("MIT", "The MIT License (MIT)\n\n © 1999 Someone\n" + by_name["MIT"]))
    rows.append(("GPL-2.0", by_name["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\n Everyone", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA\n Everyone")))
    rows += [(None, by_name["MIT"] + " and more"), (None, by_name["GPL-3.0"][:-3000]), (None, ""), (None, None), (None, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, license string")
    found = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert found == {i: k for i, (k, _) in enumerate(rows)}
    assert licenses.scan(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: r[1] for r in con.execute(f"SELECT doc_id, license FROM ({licenses.oracle()})").fetchall()} == found


def test_own_table(spark, monkeypatch):
    own = licenses.known(spark, [("A", "Some Licence text"), ("B", "some license, text!"), ("C", "other")])
    df = spark.createDataFrame([(1, "SOME  license text"), (2, "other?"), (2, "other?"), (None, None)], "doc_id long, text string")
    for most in (10, 0):
        monkeypatch.setattr(licenses, "BROADCAST_LICENSES", most)
        assert sorted(((r.doc_id or 0, r.license or "") for r in licenses.scan(df, licenses=own).collect())) == [(0, ""), (1, "A"), (2, "C"), (2, "C")]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert op9_license_scan(spark, sf_dir).count() == docs.count()
