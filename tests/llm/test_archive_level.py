"""Archives are compressed at gzip's fastest level: they are read once or twice and then dropped."""

import glob
import gzip
import zlib

from graphfacts.llm import warc


def test_archives_are_written_at_the_fastest_level(spark):
    html = [" ".join(f"word{i * k % 977} of page" for k in range(800)) for i in range(1, 21)]
    pages = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    sizes = []
    path = warc.write_arc(pages.repartition(1))
    for name in glob.glob(f"{path}/*.txt.gz"):
        with open(name, "rb") as f:
            packed = f.read()
        whole = gzip.decompress(packed)
        fast, usual = (len(zlib.compress(whole, level)) for level in (1, 6))
        assert fast > usual * 1.05
        sizes.append(abs(len(packed) - fast) < abs(len(packed) - usual))
    assert sizes and all(sizes)
    assert warc.round_trip(pages).count() == 20
