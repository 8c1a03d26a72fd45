"""Table schemas (DDL) and the expected shape of every annotator's answer."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- tables: one row kind each, keyed by clip ------------------------------------------------------
SEGMENTS = "clip_id string, seg bigint, start_us bigint, end_us bigint, left_label string, right_label string, provenance string, confidence double, draft map<string,string>"
FLAGS = "clip_id string, seg bigint, type string, raised_by string, detail string"
CONTACT = "clip_id string, hand string, t_us bigint, object string"
TRACK = "clip_id string, hand string, start_us bigint, end_us bigint, object string"
TRANSITIONS = "clip_id string, t_us bigint, hand string, kind string, object string, evidence string"
BURSTS = "clip_id string, t_us bigint, kind string, question string, verdict string, evidence string"
BURST_SUMMARY = "clip_id string, assembly bigint, disassembly bigint, majority string, runs bigint, rule string"
INVENTORY = "clip_id string, name string, role string, colour string"
SIGNALS = "clip_id string, hand string, t_us bigint, frame bigint, x bigint, y bigint, grip bigint"
SPANS = "clip_id string, seg bigint, start_us bigint, end_us bigint, type string"
FACTS = "clip_id string, seg bigint, hand string, type string, motion string, grip string, mean_speed bigint, gripr double, pres double, acting string"
ROTATION = "clip_id string, seg bigint, fastening int, turner string, direction string"
PROMPTS = "clip_id string, t_us bigint, hand string, seg_id string, primary int, x int, y int, box array<int>, hull array<array<int>>, grip double"
GROUNDING = "clip_id string, file string, hand string, t_us bigint, seg_id string, primary int, obj int, name string, conf int, low_conf int, src string"
CANDIDATES = "clip_id string, frame bigint, cand bigint, name string, mask array<bigint>, score bigint, src string, manip double, dist double"
SNAPSHOTS = "stage string, clip_id string, seg bigint, start_us bigint, end_us bigint, left_label string, right_label string, provenance string"
LEDGER = "family string, calls bigint, prompt_tokens bigint, completion_tokens bigint"
EVAL_SLOTS = "clip_id string, seg bigint, hand string, gt string, pred string, match int"

# ---- documents --------------------------------------------------------------------------------------
_SEG = "start_sec double, end_sec double, `left` string, `right` string"
_FLAG = "seg bigint, type string, raised_by string, detail string"
_QA = "seg bigint, code string, hand string, detail string"
_LANE = "start_sec double, end_sec double, action string, needs_review boolean"
EPISODE = (
    "clip string, duration_sec double, goal string, instruction string, direction string, phase_switch_sec double, "
    "objects array<struct<name: string, role: string, colour: string>>, environment struct<category: string>, "
    "meta struct<duration_sec: double, model: string>, "
    + "segments array<struct<" + _SEG.replace(" double", ": double").replace(" string", ": string") + ", boundary_provenance: string, confidence: double>>, "
    + "subtasks array<struct<" + _SEG.replace(" double", ": double").replace(" string", ": string") + ", needs_review: boolean>>, "
    + "left_timeline array<struct<" + _LANE.replace(" double", ": double").replace(" string", ": string").replace(" boolean", ": boolean") + ">>, "
    + "right_timeline array<struct<" + _LANE.replace(" double", ": double").replace(" string", ": string").replace(" boolean", ": boolean") + ">>, "
    + "_flags array<struct<" + _FLAG.replace(" bigint", ": bigint").replace(" string", ": string") + ">>, "
    + "_qa struct<violations: array<struct<" + _QA.replace(" bigint", ": bigint").replace(" string", ": string") + ">>>, "
    + "override_applied boolean"
)


@dataclass(frozen=True)
class Answer:
    """Shape of one annotator's JSON answer: columns, required keys, required keys of list items,
    and allowed values (``"field"`` or ``"list.field"``)."""

    ddl: str
    required: tuple[str, ...]
    items: dict[str, tuple[str, ...]] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)


# fixed values: keys, enums and required keys of the annotator answers
_HANDS = ("left", "right")
_DIRS = ("assembly", "disassembly", "transfer_or_portioning", "mixed_or_alternating", "other_or_ambiguous")
_IV = "array<struct<start_sec: double, end_sec: double, interacting_with: string>>"
_IV_KEYS = ("start_sec", "end_sec", "interacting_with")
_TL = "array<struct<start_sec: double, end_sec: double, `left`: string, `right`: string>>"
_TL_KEYS = ("start_sec", "end_sec", "left", "right")
_ASK = "array<struct<t: double, question: string>>"
ANSWERS = {
    "contact_track": Answer(f"`left` {_IV}, `right` {_IV}, notes string", _HANDS, {"left": _IV_KEYS, "right": _IV_KEYS}),
    "reconcile": Answer("boundaries array<double>", ("boundaries",)),
    "segment": Answer(f"boundaries array<double>, need_burst {_ASK}", ("boundaries",), {"need_burst": ("t", "question")}),
    "completeness": Answer(
        "gaps array<struct<t: double, hand: string, kind: string, object: string, in_seg: int, evidence: string>>, notes string",
        ("gaps",),
        {"gaps": ("t", "hand", "kind", "object", "evidence")},
        {"gaps.hand": ("left", "right", "both"), "gaps.kind": ("missing_pick", "missing_place", "missing_handoff")},
    ),
    "label": Answer("think string, `left` string, `right` string", ("think", "left", "right")),
    "timeline": Answer(f"think string, segments {_TL}", ("segments",), {"segments": _TL_KEYS}),
    "direction": Answer(
        "direction string, goal string, basis string, phase_switch_sec double, agrees_with_stated_task boolean, recheck_times array<double>",
        ("direction", "goal", "basis"),
        {},
        {"direction": _DIRS},
    ),
    "transitions": Answer(
        "events array<struct<t: double, hand: string, kind: string, object: string, evidence: string>>",
        ("events",),
        {"events": ("t", "hand", "kind", "object", "evidence")},
        {"events.hand": ("left", "right", "both"), "events.kind": ("place", "pickup", "handoff", "throw")},
    ),
    "merge_critic": Answer(
        "merges array<struct<delete_t: double, keep: string, reason: string>>, notes string",
        ("merges", "notes"),
        {"merges": ("delete_t", "keep", "reason")},
        {"merges.keep": ("before", "after")},
    ),
    "burst": Answer("verdict string, evidence string", ("verdict", "evidence")),
    "neighbour_review": Answer("flags array<struct<seg: int, issue: string, reason: string>>", ("flags",), {"flags": ("seg", "issue", "reason")}),
    "template_match": Answer("flags array<struct<seg: int, type: string, detail: string>>, notes string", ("flags", "notes"), {"flags": ("seg", "type", "detail")}),
    "gate": Answer(
        "purpose_check string, purpose_verdict string, direction string, findings string, merge_at_sec array<double>, split_request array<int>, "
        "corrections array<struct<seg: int, hand: string, label: string>>, quality_verdict string, rerun_feedback string, "
        "request_merge_critic boolean, request_completeness boolean",
        ("purpose_check", "purpose_verdict", "direction", "findings", "merge_at_sec", "split_request", "corrections", "quality_verdict",
         "rerun_feedback", "request_merge_critic", "request_completeness"),
        {"corrections": ("seg", "hand", "label")},
        {"purpose_verdict": ("confirmed", "corrected"), "direction": _DIRS, "quality_verdict": ("good", "needs_rerun"), "corrections.hand": _HANDS},
    ),
    "audit": Answer(f"reads_correctly boolean, segments {_TL}, notes string", ("reads_correctly", "segments", "notes"), {"segments": _TL_KEYS}),
}
