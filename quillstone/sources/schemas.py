"""Schemas of the practice records, as Spark DDL. `user_id` partitions every table by tenant."""

from __future__ import annotations

from pyspark.sql.types import StructType

LOG = "struct<ts:bigint,kind:string,note:string,strokes:int,resolved:boolean,topic:string,errorKind:string>"
STROKE = "struct<id:string,t0:bigint,t1:bigint,c:string,w:double,pts:array<array<double>>,dead:bigint>"
DDL = {
    "question": "id string, topic string, type string, diff int, q string, opts array<string>, ans_idx array<int>, ans_txt array<string>, target int, sol string, tip string, src string, rev bigint, grp string, stem string, fig string, solFig string, needsFigure boolean, dup boolean",
    "attempt": "user_id string, qid string, ok boolean, ms bigint, err string, d date, mode string, ts bigint, confidence string, p struct<fi:int,hes:array<array<int>>,era:int,tail:int,n:int>, ai struct<fe:string,nt:string,k:string,d:string>",
    "wrong": "user_id string, qid string, fails int, wins int, itv int, err string, due date, mt bigint, grad string",
    "mock": "user_id string, d date, score double, total int, ok double, n int, acc double, mixedGroupId string, ts bigint",
    "ext_mock": "user_id string, id string, paperRunId string, sourceId string, d date, ts bigint, mt bigint, name string, score double, total int, questions int, calibrationEligible boolean, topics array<string>, errors array<string>",
    "correction_entry": "user_id string, batch_id string, mockTs bigint, mt bigint, due date, qid string, examNo int, points double, done boolean, level int, outcome string, attempts int, completedAt bigint, solutionUnlockedAt bigint, logs array<" + LOG + ">",
    "paper_run": "user_id string, id string, sourceId string, status string, d string, due date, createdAt bigint, submittedAt bigint, mt bigint, score double, wrongNos array<int>, topics array<string>, errors array<string>",
    "review": "user_id string, run_id string, no int, attempts int, done boolean, level int, topic string, errorKind string, completedAt bigint, solutionUnlockedAt bigint, detailFirstOpenedAt bigint, detailLastOpenedAt bigint, detailViewCount int, mt bigint, logs array<" + LOG + ">",
    "grade_item": "user_id string, run_id string, no int, status string, points double, finalAnswer string, selectedOptions array<int>, hasFinalAnswer boolean, manual boolean, manualAt bigint, mt bigint, gradedAt bigint, adjustedAt bigint",
    "pack_item": "pack_id string, pack_rev bigint, kind string, name string, id string, rev bigint, value string, pos bigint",
    "ink_record": "client_id string, user_id string, qid string, t0 bigint, updatedAt bigint, uploaded boolean, upload_state string, strokes array<" + STROKE + ">, deleted array<string>",
    "usage": "user_id string, usage_date date, request_count int, request_weight int, input_tokens bigint, output_tokens bigint, last_request_at timestamp",
    "method": "id bigint, unit string, lec int, concept string, method string, mnemonic string, black string, ex string, created_at timestamp",
    "app_state": "user_id string, data string, revision bigint",
}
#: Topics of the question bank.
TOPICS = {
    "num": "數與式", "line": "直線與圓", "poly": "多項式函數", "seq": "數列與級數", "comb": "排列組合", "prob": "機率", "data": "數據分析",
    "trig1": "三角比", "trig2": "三角函數", "exp": "指數與對數", "vec": "平面向量", "svec": "空間向量", "splane": "空間中的平面與直線", "mat": "矩陣",
}
#: Topics that the bank builder knows; two of the keys differ.
BUILDER_TOPICS = ["num", "line", "poly", "seq", "comb", "prob", "data", "trig1", "trig2", "exp", "vec", "vec3", "space", "mat"]
TYPES = ["single", "multi", "fill"]
RESERVED_IDS = ["__proto__", "constructor", "prototype"]


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
