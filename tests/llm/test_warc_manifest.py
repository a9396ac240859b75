"""Only the files that the manifest names count: others in the folder are of attempts that failed or were repeated."""

from pyarrow import fs

from sievemark.llm import warc
from sievemark.llm.common import new_folder


def test_stray_files(spark, monkeypatch):
    folder = new_folder(spark, "warc")
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 3}</p>") for i in range(7)], "page_id long, url string, html string").repartition(3)
    want = sorted(map(tuple, warc.digest(df).collect()))
    assert len(want) == 7
    warc.write_warc(df, folder)  # complete files of an attempt that doesn't count
    whole = warc.member(warc.record("response", "<urn:record:99>", "u", "D", b"x" * 5000, 5000, None))
    with open(f"{fs.FileSystem.from_uri(folder)[1]}/cut.warc.gz", "wb") as f:
        f.write(whole[: len(whole) - 12])
    monkeypatch.setattr(warc, "new_folder", lambda spark, what: folder)
    assert sorted(map(tuple, warc.digest(df).collect())) == want
    assert warc.digest(df.limit(0)).count() == 0
