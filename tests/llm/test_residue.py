"""The material of the residue models is no copy of documents, and models find what the material lacks."""

from __future__ import annotations

import os
import random

import ahocorasick
import pyarrow.parquet as pq
import pytest

from quillmere.llm.residue import ResidueModel, residue_documents
from quillmere.llm.residue_seeds import MESSAGES, material

PROSE = ["合同DD100001的到期提醒提前30天发出，收件人为区域经理。", "夜间任务会在03:00重跑失败的部分，成功的结果不会覆盖。", "权限申请需写明用途、期限和数据范围，缺一项就退回。", "Ticket TS-1 was reopened by the night shift and closed two hours later.", "通知模板里的变量写作 {{customer_name}}，发送前由消息平台替换，编辑时不要改动花括号。", "有用户反映点开办法时浏览器显示“404 页面不存在”，原因是链接少了一段路径，补全后即可打开。", "The auditor asked for the list of groups that changed between May and today."]

DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"


def test_no_line_of_the_material_stands_in_the_documents():
    """But for phrases of up to 25 characters that anyone would write, such as "404 Not Found", under 1 % of the lines, and the first line of Python's traces."""
    if not os.path.exists(DOCUMENTS):
        pytest.skip("no documents here")
    texts = [x for x in pq.read_table(DOCUMENTS, columns=["text"]).column(0).to_pylist() if x]
    for lines in material().values():
        lines = set(lines)
        every = ahocorasick.Automaton()
        for line in lines:
            every.add_word(line, line)
        every.make_automaton()
        found = {line for text in texts for _, line in every.iter(text)}
        assert len(found) < 0.01 * len(lines)
        assert all(len(line) <= 25 for line in found - {"Traceback (most recent call last):"})


@pytest.mark.parametrize("without", [("trace",), ("en_script", "zh_script", "browser"), ("zh_error", "en_error"), ("status", "system")])
def test_left_out_kinds_are_found(spark, without):
    """Pages with three lines of a kind that the material lacks, between titles of the corpus, are found; nothing else is."""
    rng = random.Random(11)
    prose = ["会议记录\n" + "\n".join(rng.choice(PROSE) for _ in range(12)) for _ in range(1500)]
    rest = material(without=without)
    lines = sorted(set(material(seed=5, without=tuple(k for k in MESSAGES if k not in without))["notice"]) - set(rest["notice"]))
    pages = ["会议记录\n" + "\n".join(rng.sample(lines, 3)) for _ in range(100)]
    rows = spark.createDataFrame(list(enumerate(prose + pages)), "doc_id long, text string")
    hits = {r["doc_id"] for r in residue_documents(rows, "doc_id", "text", rest).collect()}
    assert len(hits & set(range(1500, 1600))) >= 90 and not hits & set(range(1500))


def test_fields_of_any_name_in_letters(spark):
    """A letter with fields whose names and wording no material shows is found; prose that tells of fields is not."""
    rng = random.Random(12)
    prose = ["\n".join(rng.choice(PROSE) for _ in range(12)) for _ in range(1500)]
    letters = ["{{zq_kw}}号仓库的{{货架位}}将于{{盘点夜}}清点。", "<<Bürgermeister>> ha recibido ${quittung} de [[vuxor]].", "凭[[凭证串]]到##柜台##领取__物件名__。"]
    rows = spark.createDataFrame(list(enumerate(prose + letters)), "doc_id long, text string")
    assert {r["doc_id"] for r in residue_documents(rows, "doc_id", "text").collect()} == {1500, 1501, 1502}


def test_tables_follow_the_length_of_texts_not_their_number():
    assert ResidueModel.widths(968.0) == (1 << 21, 1 << 20)
    assert ResidueModel.widths(20_000.0)[0] == 1 << 25 and ResidueModel.widths(0.0) == (1 << 18, 1 << 18)


def test_long_pages_keep_unknown_notices(spark):
    """With documents of twenty times the length an unknown notice is still found."""
    rng = random.Random(13)
    words = ["".join(rng.choice("合同编号发货仓库客户审批财务报表系统日志会议纪要夜班交接流程单据物流库存采购预算") for _ in range(3)) for _ in range(300)]
    sentences = ["".join(rng.choice(words) for _ in range(5)) + "。" for _ in range(400)]
    prose = ["\n".join(rng.choice(sentences) for _ in range(800)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate([*prose, "柱塞咬死，舵机离线"])), "doc_id long, text string")
    assert {r["doc_id"] for r in residue_documents(rows, "doc_id", "text").collect()} == {300}
