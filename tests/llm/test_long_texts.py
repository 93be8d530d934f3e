"""Very long and odd texts take time in proportion to their length."""

import time

import pytest

from quillmark.llm import copies, defects, endings, leaks
from quillmark.llm.truncation import verdict

TEXTS = {"letters": "a" * 200_000, "blanks": "x" + " " * 200_000 + "y", "lines": "\n " * 100_000, "dots": "." * 100_000, "tags": "<b" * 60_000, "escapes": "\\" * 100_000, "entities": "&" * 100_000, "fields": "a:|" * 40_000, "chinese": "中文" * 60_000}


@pytest.mark.parametrize("name", TEXTS)
def test_long(name):
    t = TEXTS[name]
    began = time.process_time()
    verdict(t)
    endings.Positions([t])
    leaks.readings(t)
    copies.canonical(t)
    defects.is_empty(t), defects.is_copy(t, t[:500]), defects.is_refusal(t, t), defects.wrong_language(t, t)
    assert time.process_time() - began < 10
