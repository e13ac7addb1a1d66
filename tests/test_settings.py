from __future__ import annotations

import pytest

from orewright import settings


def test_env_file(tmp_path, monkeypatch):
    for k in ("ORE_A", "ORE_B", "ORE_C"):
        monkeypatch.delenv(k, raising=False)
    monkeypatch.setenv("ORE_B", "mine")
    (tmp_path / ".env").write_text("# note\nORE_A = \"x=1\"\nORE_B=file\nno line\n\nORE_C='q'\n")
    settings.load_env(tmp_path / ".env")
    assert [settings.require(k) for k in ("ORE_A", "ORE_B", "ORE_C")] == ["x=1", "mine", "q"]
    settings.load_env(tmp_path / "none")
    for k in ("ORE_A", "ORE_C"):
        monkeypatch.delenv(k)
    with pytest.raises(RuntimeError, match="ORE_A"):
        settings.require("ORE_A")


def test_dsn_quotes(monkeypatch):
    monkeypatch.setenv("POSTGRES_USER", "a b")
    monkeypatch.setenv("POSTGRES_PASSWORD", "p@ss/w")
    monkeypatch.setenv("POSTGRES_HOST", "h")
    assert settings.postgres_dsn() == "postgresql://a+b:p%40ss%2Fw@h:5432/postgres"
    assert settings.credentials("postgres") == ("a b", "p@ss/w")
    assert settings.jdbc_options("x.y")["dbtable"] == "x.y"


def test_env_lines():
    text = "A=1 # why\nB='a # b'\nC=\"x y\" # z\n#D=1\n E = 5 \nA=2\nF\n=g\nH=\n"
    assert settings.parsed_env(text) == {"A": "1", "B": "a # b", "C": "x y", "E": "5", "H": ""}
