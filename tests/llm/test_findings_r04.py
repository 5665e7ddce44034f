"""Memory of Python workers: what the findings of round 4 were about."""

import re
from pathlib import Path

from noticeworks.llm import common


def taken():
    """MB of this process that belong to no file."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_release_gives_freed_texts_back():
    """Texts that are freed beneath one that stays go back to the system."""
    texts = [bytes(1000) for _ in range(100_000)]
    last = texts[-1]
    texts.clear()
    common.release()
    before = taken()
    texts = [bytes(1000) for _ in range(100_000)] + [last]
    full, last = taken(), texts[-2]
    texts.clear()
    common.release()
    assert full > before + 70 and taken() < full - 70 and len(last) == 1000
