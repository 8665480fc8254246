from __future__ import annotations

import pytest

from linegrain.session import build_session

# The 43 lines of the internal corpus: artifact, then "TOKENS = quantity" entries.
INTERNAL = {
    "HT10": "DA NE = 2; KU RA2 TE = 2; KU RA2 SI = 10; KU RA2 NE = 15; KU RA2 TA = 32; KU RA2 = 70",
    "HT12": "OLIV = 5; QA TU = 8; MA RU = 10; KU RA2 = 28; QE TU NE = 30; DA I = 50",
    "HT13": "AB04 AB40 AB22 AB59 = 2; AB54 AB67 AB22 AB03 = 5; AB51 AB24 AB22 AB09 = 7; "
    "AB81 AB02 AB22 AB67 = 12",
    "HT31": "AB54 AB67 AB22 AB03 = 2; AB28 AB67 AB22 AB54 = 4; AB54 AB28 AB22 AB09 = 5; "
    "AB81 AB02 AB22 AB28 = 7; AB51 AB45 AB22 AB59 = 8; AB81 AB02 AB22 AB67 = 10",
    "HT7": "DA NA TU = 1; KI RA = 1; TU RU SI = 1; QE TU RA = 2; TI RU SI = 2",
    "HT8": "SUP ? = 1; KU RA = 2; PA3 = 3; QA KI = 5; OLIV KI = 10",
    "HT9": "VIN TE = 18; VIN TE = 19; VIN TE = 25; VIN TE = 51; VIN TE = 87; VIN TE = 130",
    "HT95": "AB54 AB67 AB22 AB03 = 2; AB81 AB02 AB22 AB67 = 10",
    "ZA10": "AB04 AB69 AB22 AB67 = 1; AB27 AB17 AB22 AB40 = 3; AB81 AB02 AB22 AB67 = 9",
}


def internal_rows() -> list[tuple[str, str, list[str], int]]:
    rows = []
    for artifact, text in INTERNAL.items():
        for i, entry in enumerate(text.split(";")):
            tokens, quantity = entry.split("=")
            rows.append((f"{artifact}|{i:02d}", artifact, tokens.split(), int(quantity)))
    return rows


@pytest.fixture(scope="session")
def spark():
    session = build_session("linegrain-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def internal(spark):
    return spark.createDataFrame(
        internal_rows(), "line_id string, artifact_id string, signs array<string>, quantity int"
    ).cache()
