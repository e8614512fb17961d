import re
from pathlib import Path

from arkloom.llm import store


def test_sweep_frees_the_drivers_native_memory(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    used = lambda: int(re.search(r"\nRssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    packers = [jvm.java.util.zip.Deflater() for _ in range(800)]
    for p in packers[:-1]:
        p.end()  # the last one's memory lies above what these leave
    before = used()
    store.sweep(spark)
    assert before - used() > 50
    packers[-1].end()
