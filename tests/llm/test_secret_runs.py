"""Long unbroken runs pass the allow list without recursion."""

import pytest
from common import frame

from quillrank.llm import secret_scan


@pytest.mark.parametrize("n", [100, 20_000, 100_000])
def test_long_run_of_words_and_signs(spark, n):
    secret = "ab-12/" * 100 + "Zx81kQpL02mNvB73sTyU9aWc"
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(frame(spark, ["ab-12/" * n, secret])).collect()}
    assert got[0] == [] and [(x["start"], x["end"]) for x in got[1]] == [(0, len(secret))]
