"""Skeletons, exact encoding, personal information and stuffed pages on small fixtures."""

import base64
import importlib.util
import os
import random
import time
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacre.llm import confusables, pii, spam, tokens
from lacre.llm.bpe import PrefixEncoder

FOLDER = tokens.VOCABULARIES
have_vocabulary = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


# confusables


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｐａｙ ｎｏｗ", "pay now"), ("pa​y n­ow", "pay now"), ("рау nоw", "pay now"), ("𝗉𝖺𝗒 𝚗𝚘𝚠", "pay now"), ("ﬁnal", "final"), ("іgnorе", "ignore"), ("página", "página"), ("página", "página"),
        ("", ""), ("​ ", ""), ("PAY", "PAY"), ("Hello…", "Hello..."),
    ],
)
def test_skeleton(skeleton, text, want):
    assert skeleton(text) == skeleton(want)


@pytest.fixture(scope="module")
def skeleton(spark):
    return confusables.skeleton_function(confusables.look_alikes(spark))


@pytest.mark.parametrize(("one", "other"), [("т", "t"), ("м", "m"), ("ᴛ", "t"), ("ⲟ", "o"), ("paypa1", "paypal"), ("rnail", "mail"), ("0CR", "OCR"), ("ꮯ", "c"), ("ʙ", "b"), ("ᎠО", "DO")])
def test_alike(skeleton, one, other):
    assert skeleton(one) == skeleton(other)


@pytest.mark.parametrize(("one", "other"), [("pay", "Pay"), ("pagina", "página"), ("pay now", "paynow"), ("pay-now", "pay now"), ("b", "d"), ("3", "8")])
def test_not_alike(skeleton, one, other):
    assert skeleton(one) != skeleton(other)


def test_look_alikes_have_stable_prototypes(spark):
    table = confusables.look_alikes(spark)
    assert len(table) > 3000
    assert all(p.translate(table) == p for p in table.values())


def test_skeleton_is_stable(skeleton):
    one = skeleton
    for text in ("Оculte a assinatura", "ﬁ́ x", "a" * 100_000):
        assert one(one(text)) == one(text)


def test_confusables_found(spark):
    phrases = spark.createDataFrame([(1, "Pay now", "en", "c"), (2, "Página", "pt", "c"), (3, " ", "pt", "c")], "phrase_id long, phrase string, lang string, category string")
    spans = spark.createDataFrame([(1, "Рay now", "k"), (1, "Рay now", "k"), (2, "Pay now", "k"), (3, None, "k"), (4, "pay now", "k"), (5, "Pay nowx", "k"), (6, "", "k"), (7, "​", "k")], "span_id long, text string, skeleton string")
    ev = spark.createDataFrame([(9, "Página", "Página"), (10, None, "Pagina")], "evidence_id long, original_excerpt string, normalized_excerpt string")
    got = {tuple(r) for r in confusables.found(spans, ev, phrases).collect()}
    assert got == {("spans.text", 1, 1), ("evidences.original_excerpt", 9, 2), ("evidences.normalized_excerpt", 9, 2)}
    assert confusables.found(spans.where("false"), ev.where("false"), phrases).count() == 0


# encoding


@pytest.fixture(scope="module")
def encoders():
    tiktoken = pytest.importorskip("tiktoken")
    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{FOLDER}/__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    data = tokens.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return PrefixEncoder(data), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@have_vocabulary
def test_encoding_equals_the_library(encoders):
    ours, theirs = encoders
    rng = random.Random(3)
    alphabet = ["abcdefghij", "   \n\t  ", "éãçñøΩжд中文😀𝟙", "0123456789½", "'s've'll!?.,-_", "<|endoftext|>"]
    texts = ["", " ", "\n\n", "a" * 5000, "é" * 700, " " * 3000, "0x" + "ab" * 500] + ["".join(rng.choice(rng.choice(alphabet)) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t)
        assert ours.count(t) == len(ours.encode(t))


@have_vocabulary
@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_encoding_of_any_text(encoders, text):
    ours, theirs = encoders
    text = text.encode("utf-8", "ignore").decode()
    assert ours.encode(text) == theirs.encode_ordinary(text)


@have_vocabulary
def test_encode_table(spark, encoders):
    rows = [(1, None, 7), (2, "", 7), (3, "Olá, mundo", 7), (3, "Olá, mundo", 7), (None, " ", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode(df, tokens.vocabulary()).collect()), key=str)
    assert got == sorted(((i, encoders[1].encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    assert tokens.encode(df.where("false"), tokens.vocabulary()).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in tokens.count(df, tokens.vocabulary()).collect()} == {(i, len(encoders[1].encode_ordinary(t or ""))) for i, t, _ in rows}


# personal information

NAMES = ["Aurélio", "Pascoal", "Zulmira", "Vilarinhos", "Marlowe", "Prado"]
CASES = [
    ("Titular: AURÉLIO VILARINHOS  CPF: 400.165.865-81", [("NAME", "AURÉLIO VILARINHOS"), ("ID", "400.165.865-81")]),
    ("E-mail do titular:zulmira+conta@mail.example.org, fim", [("EMAIL", "zulmira+conta@mail.example.org")]),
    ("mail aurelio (at) postalia (dot) example;", [("EMAIL", "aurelio (at) postalia (dot) example")]),
    ("cc x.prado[arroba]caixa.example.net e arquivo", [("EMAIL", "x.prado[arroba]caixa.example.net")]),
    ("ligue +55 (52) 90706 9192 em horário comercial", [("PHONE", "+55 (52) 90706 9192")]),
    ("recado no 0055 25 9 0054 9738 com o porteiro", [("PHONE", "0055 25 9 0054 9738")]),
    ("Tel. (50) 90844‑8894", [("PHONE", "(50) 90844‑8894")]),
    ("fone/fax 555-0157 / Phone: 80902042928", [("PHONE", "555-0157"), ("PHONE", "80902042928")]),
    ("residente na Tv. das Hortênsias - n. 4385, apto 694", [("ADDRESS", "Tv. das Hortênsias - n. 4385")]),
    ("RUA DAS LAVADEIRAS, s/n, CEP 28713-523", [("ADDRESS", "RUA DAS LAVADEIRAS, s/n")]),
    ("instalação em 9126 St. Alban St., Suite 600 - Vila Serrana", [("ADDRESS", "9126 St. Alban St.")]),
    ("Social security no. 970-33-7444 / passaporte nº FX302148", [("ID", "970-33-7444"), ("ID", "FX302148")]),
    ("Dear Ms. Rosamund Marlowe, Dr. a. prado assinou o laudo", [("NAME", "Rosamund Marlowe"), ("NAME", "a. prado")]),
    ("declaro que Vilarinhos, Pascoal esteve presente", [("NAME", "Vilarinhos, Pascoal")]),
    ("Gerôncio da Harrowgale compareceu ao balcão", [("NAME", "Gerôncio da Harrowgale")]),
    ("Beneficiário: Marlowe Freight Inc. CNPJ 63.780.765/0001-75", []),
    ("Linha digitável 73061.04706 89042.109856 36541.206027 6 04519251453467", []),
    ("Protocolo 48078357505 Conta 8076 / 9503487-3 perfil @lote_503 31 un @ 62,61", []),
    ("no fim da rua ao lado do depósito, Estrada de Ferro Pontal S.A.", []),
    ("Vencimento 12/02/2025 CEP 81010-000 Nosso número 96461919-7", []),
    ("", []),
    ("x" * 50_000, []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_finds(text, want):
    got = [(k, text[a:b]) for k, a, b in pii.Finder(NAMES).find(text)]
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789", min_size=1, max_size=14), st.binary(min_size=1, max_size=8))
def test_feistel_round_trip(value, key):
    p = pii.Pseudonyms(key)
    hidden = p.digits(value, "x")
    assert len(hidden) == len(value) and p.digits(hidden, "x", back=True) == value


def test_feistel_is_a_permutation():
    p = pii.Pseudonyms(b"k")
    assert len({p.digits(f"{i:03}", "x") for i in range(1000)}) == 1000
    days = {p.day(date(2024, 1, 1 + i)) for i in range(31)}
    assert len(days) == 31 and all(1900 <= d.year <= 2099 for d in days)


def test_pseudonyms_keep_the_format():
    p = pii.Pseudonyms(b"k")
    new = p.number("400.165.865-81", "ID")
    assert pii.is_cpf("40016586581") == pii.is_cpf("".join(c for c in new if c.isdigit()))
    assert [c for c in new if not c.isdigit()] == [".", ".", "-"]
    valid = "529.982.247-25"
    assert pii.is_cpf("".join(c for c in p.number(valid, "ID") if c.isdigit()))
    assert p.number(valid, "ID") == p.number(valid, "ID") != pii.Pseudonyms(b"other").number(valid, "ID")
    assert p.tag("Aurélio  Prado", "NAME") == p.tag("AURELIO PRADO", "NAME")


def test_pii_tables(spark):
    a = spark.createDataFrame([("A", "Pagador Pascoal Prado. x", "k"), ("A", "Pagador Pascoal Prado. x", "k"), ("B", None, "k"), ("C", "", "k")], "doc_id string, native_text string, kind string")
    b = spark.createDataFrame([(7, "Tel. (56) 4439-5346"), (8, None), (9, " ")], "box_id long, text string")
    n = spark.createDataFrame([(x, "given") for x in NAMES], "name_part string, part_kind string")
    assert {tuple(r) for r in pii.found(a, b, n).collect()} == {("native_text", "A", "NAME", 9), ("boxes.text", "7", "PHONE", 6)}
    new = {(r.src, r.rec_key): r.text for r in pii.replaced(pii.records(a, b), NAMES, b"k").collect()}
    assert new["native_text", "A"].startswith("Pagador [NAME ") and new["native_text", "A"].endswith("]. x") and "4439" not in new["boxes.text", "7"]
    assert pii.found(a.where("false"), b.where("false"), n.where("false")).count() == 0


# stuffed pages


def test_stuffed_pages(spark):
    sentence = "O relatório de perícia confirma o vencimento original da cobrança durante a triagem inicial. "
    links = "\n".join(f"https://pdf-top{i}.example/gerar-boleto/{i}" for i in range(12))
    tags = " ".join("#GerarBoleto #ImagemDigitalizada" for _ in range(10))
    words = "\n".join(f"leitura óptica pdf {i}" for i in range(12))
    places = " • ".join(f"scanner barato em {p}" for p in ("Monte Alvor", "Barra", "Lagoa Parda", "Vila Serrana", "Campo Ruivo", "Porto Aldeia"))
    bill = "Energia S.A.\nNº 3269299040\nTotal R$ 3.102,30\nVencimento 12/02/2025\nCEP 27845-137 Santa Quintina\nProtocolo 68713037589\n"
    statement = "\n".join(f"{i:02}/05/2024\ttransfer out\t{i}9,74\tD" for i in range(1, 20))
    rows = [
        (1, links), (2, tags), (3, words), (4, places), (4, places), (5, sentence * 8 + links), (6, bill), (7, statement), (8, sentence * 6), (9, None), (10, ""), (11, " \n"), (12, "base64:" + "QWzDqW0g" * 60), (13, sentence * 5 + "\nReferences:\n[1] https://a.example/1\n[2] https://b.example/2"),
        (14, links * 50 + sentence),
    ]
    df = spark.createDataFrame([(i, t, None if i % 3 else f"h{i}", 1) for i, t in rows], "doc_id long, text string, source string, host int")
    assert {r.doc_id for r in spam.found(df).collect()} == {1, 2, 3, 4, 14}
    assert spam.found(df.where("false")).count() == 0


def test_stuffing_in_one_long_line(spark):
    rng = random.Random(8)
    words = "converter vencimento editar free comprovante pdf grátis editor original boleto".split()
    pair = ("relatório de perícia 2025", "comprovante anexado 2025", "gerar boleto")
    places = ("Monte Alvor", "Barra Mansinha", "Lagoa Parda", "Vila Serrana", "Campo Ruivo", "Porto Aldeia")
    once = "nota barata emitir agora sem custo scanner online leitor óptico rápido grátis já conversor total"
    prose = "O relatório de perícia confirma o vencimento original da cobrança. A carta de cobrança confirma o vencimento original. O relatório de perícia altera a carta de cobrança. A carta de cobrança altera o relatório de perícia "
    rows = [
        (1, " ".join(rng.choice(words) for _ in range(120))), (2, " / ".join(rng.choice(pair) for _ in range(40))), (3, " ".join(rng.choice(pair).upper() for _ in range(40)) + " O recibo confirma o total."),
        (4, " ".join(f'<a href="https://pdf-top{i}.example/{i}">leitor óptico</a>' for i in range(12))), (5, ". ".join(f"scanner barato em {p}" for p in places) + "."), (6, " ".join("gerarboletográtis" * 20)),
        (7, once), (8, once), (9, once), (10, prose * 3), (11, "hex:" + "496e206974656d2031" * 60), (12, " ".join(f"{i:02}/05/2024 transfer out {i}9,74 D" for i in range(1, 28))), (13, "um aviso comprido sem marcas que aparece somente numa única página desta coleção inteira de documentos variados"),
    ]
    df = spark.createDataFrame([(i, t, f"h{i}") for i, t in rows], "doc_id long, text string, source string")
    assert {r.doc_id for r in spam.found(df).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9}


def test_phrases_in_list_rows_count_for_hosts(spark):
    """Phrases that stand on other hosts in rows of lists or with a common head only, once each on a page of their own."""
    rows = ["gerar boleto grátis", "conversor rápido online", "nota fiscal barata", "leitor óptico novo", "assinatura digital agora"]
    dense = [f"scanner barato em {p}" for p in ("Barra", "Lagoa", "Ribeira")]
    texts = [" | ".join(rows)] * 3 + ["\n".join(dense)] * 3 + ["\n".join([*rows, dense[1], "texto único"])]
    df = spark.createDataFrame([(i, t, f"h{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    p = {r.doc_id: r for r in spam.scores(df).collect()}
    assert p[6].segments == 6 and 0.8 < p[6].list_share < 1 and p[0].list_share == 1 and p[0].segments == 5
    assert 6 in {r.doc_id for r in spam.found(df).collect()}


def test_long_contexts_are_read_whole():
    f = pii.Finder(["maria", "silva"])
    mail = "a" * 200 + "@mail.example.com"
    assert f.find(f"x {mail}") == [("EMAIL", 2, 2 + len(mail))]
    assert f.find("Tel." + " " * 100 + "98765432") == [("PHONE", 104, 112)]
    name = "Maria " + "Abcdefghijkl " * 30 + "Silva"
    assert f.find(f"x {name}, y") == [("NAME", 2, 2 + len(name))]


def test_many_finds_in_one_text_take_linear_time():
    f = pii.Finder(["maria"])
    text = " ".join(f"(11) 98765-{i % 10_000:04d};" for i in range(20_000))
    began = time.perf_counter()
    assert len(f.find(text)) == 20_000
    assert time.perf_counter() - began < 5


def test_taken_spans():
    t = pii.Taken([(5, 8), (7, 10), (20, 21)])
    assert t.spans == [(5, 10), (20, 21)]
    assert t.free(0, 5) and t.free(10, 20) and not t.free(9, 11) and not t.free(0, 30) and not t.free(6, 7)
    t.add(11, 12)
    assert not t.free(10, 20) and t.free(12, 20)


def test_pseudonyms_keep_prefixes_and_days():
    p = pii.Pseudonyms(b"k")
    new = p.number("+55 (11) 98765-4321", "PHONE")
    assert new.startswith("+55 (11) 98") and len(new) == 19 and new != "+55 (11) 98765-4321"
    assert p.number("98765-4321", "PHONE")[:2] == "98"
    text = p.dates("03/04/1980, 2020-02-30, 1999-12-31 e 31.12.1999")
    a, b, c, d = text.replace(" e ", ", ").split(", ")
    assert b == "2020-02-30" and a != "03/04/1980" and c == "-".join(reversed(d.split(".")))
    assert p.replace("em 03/04/1980", []) == "em 03/04/1980" and p.replace("em 03/04/1980", [], dates=True) == f"em {a}"
