"""Who speaks: from labels, aligned sources, names in the dialogue and, last, the shape of the dialogue.

A project has few labels and its stages build on each other, so one grouped map per project decides;
evidence that stands alone (profiles, name votes) is also available as plain DataFrames.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import spoken
from ..functions import text as T
from . import alignment as A
from .spread import spread

PROMPT = re.compile(N.PROMPT)
VERSIONS = ("final_text", "zoom_text", "chatgpt_text", "model_text", "gold_text")
SOURCES = ("zoom", "gold", "chatgpt")
# Weights of evidence for a name.
LABEL, SELF, ALIGNED, LEARNER_ID, ADDRESSED = 8, 7, 5, 4, 3
PROJECT_SELF, PROJECT_SAVED, PROJECT_TURN, PROJECT_ID = 12, 7, 5, 3
FIXED_ROLES = frozenset((N.AI, N.TEACHER, N.SUPERVISOR))


class Cast:
    """One project's speakers. turns: dicts of a turn's columns; sources: name to segments."""

    def __init__(self, turns: list[dict], sources: dict[str, list[A.Segment]], conversation_type: str, learner_id: str, saved: dict[str, str]):
        self.turns, self.sources, self.kind, self.learner_id = turns, sources, conversation_type, learner_id
        self.mapping = dict(saved)
        self.reasons: dict[str, str] = {}
        self._hits: dict[tuple, list] = {}

    def matched(self, source: str) -> list[A.Segment | None]:
        """Each turn's strongest segment of a source."""
        segments = self.sources.get(source) or []
        key = source, tuple(t["speaker_raw"] for t in self.turns)
        if key not in self._hits:
            own = [A.Turn(t["start"], t["end"], t["speaker_raw"], {c: t[c] for c in A.ANCHORS}) for t in self.turns]
            self._hits[key] = [segments[k] if k is not None else None for k in A.align(own, segments)[1]] if segments else [None] * len(self.turns)
        return self._hits[key]

    # -- labels

    def best_source(self) -> str | None:
        ranked = [
            (any(A.timed(s) for s in labelled), A.PREFERENCE[name], name)
            for name in SOURCES
            if (labelled := [s for s in self.sources.get(name, []) if N.usable(s.speaker)])
        ]
        return max(ranked)[2] if ranked else None

    def uploaded(self) -> dict[int, str]:
        """Turns' labels that come from a file: their own if a file has it, else the strongest aligned one."""
        have = {spoken.normalized(s.speaker) for name in SOURCES for s in self.sources.get(name, []) if N.usable(s.speaker)}
        out = {i: N.squeeze(t["speaker_raw"]) for i, t in enumerate(self.turns) if N.usable(t["speaker_raw"]) and spoken.normalized(t["speaker_raw"]) in have}
        for name in dict.fromkeys((self.best_source(), *SOURCES)):
            if name and self.sources.get(name):
                for i, s in enumerate(self.matched(name)):
                    if i not in out and s and N.usable(s.speaker):
                        out[i] = N.squeeze(s.speaker)
        return out

    def role_of(self, label: str) -> tuple[str | None, str]:
        form, own = spoken.normalized(label), spoken.normalized(self.learner_id)
        if form in N.UNKNOWN_LABELS:
            return None, "no label"
        if own and (form == own or set(spoken.words(own)) <= set(spoken.words(form))):
            return N.STUDENT, "the learner's id"
        return N.role(label, self.kind), "a role's name"

    def lookup(self, label: str) -> str | None:
        for key in (label, N.squeeze(label)):
            if self.mapping.get(key):
                return self.mapping[key]
        form = spoken.normalized(label)
        return next((v for k, v in self.mapping.items() if form and spoken.normalized(k) == form), None)

    def kept_label(self, turn: dict) -> str | None:
        """The turn's label if it maps to itself: it came from a file and stays as it is."""
        raw, to = N.squeeze(turn["speaker_raw"]), self.lookup(turn["speaker_raw"])
        return raw if to and N.usable(raw) and spoken.normalized(to) == spoken.normalized(raw) else None

    def declared(self, turn: dict) -> str | None:
        return N.clear_winner(Counter(n for v in self.versions(turn) for n in N.declared(v)))

    @staticmethod
    def versions(turn: dict) -> list[str]:
        return list(dict.fromkeys(v for c in VERSIONS if (v := N.squeeze(turn[c]))))

    # -- stages

    def run(self) -> dict[str, str]:
        uploaded = self.uploaded()
        for i, label in uploaded.items():
            self.turns[i]["speaker_raw"] = self.turns[i]["speaker"] = label
        every = [t["speaker_raw"] for t in self.turns] + [s.speaker for own in self.sources.values() for s in own]
        labels = sorted({x.strip() for x in every if x.strip() and N.usable(x)})
        found: dict[str, str] = {}
        for label in labels:
            kept = N.identity(self.mapping.get(label, ""), self.kind)
            role, why = (kept, "saved before") if kept else self.role_of(label)
            if role:
                found[label], self.reasons[label] = role, why
        self.from_sources(labels, found)
        raw = sorted({t["speaker_raw"].strip() for t in self.turns if N.usable(t["speaker_raw"])})
        self.by_elimination(raw, found)
        self.by_dialogue(raw, found)
        self.learners_names(raw, found)
        for name in SOURCES:  # labels of sources take their turn's identity
            for t, s in zip(self.turns, self.matched(name), strict=True):
                who = found.get(t["speaker_raw"].strip())
                if s and N.usable(s.speaker) and who and who != N.UNKNOWN and s.speaker.strip() not in found:
                    found[s.speaker.strip()], self.reasons[s.speaker.strip()] = who, f"aligned with {name}"
        for label in set(uploaded.values()):
            found[label], self.reasons[label] = label, "from a file"
        self.apply({label: found.get(label, N.UNKNOWN) for label in labels})
        return self.mapping

    def from_sources(self, labels: list[str], found: dict[str, str]) -> None:
        """Roles that aligned Gold or ChatGPT labels name, by vote."""
        votes: dict[str, Counter] = {label: Counter() for label in labels}
        for name in ("gold", "chatgpt"):
            for t, s in zip(self.turns, self.matched(name), strict=True):
                label = t["speaker_raw"].strip()
                if s and label in votes and (role := self.role_of(s.speaker)[0]):
                    votes[label][role] += 1
        for label in labels:
            if label not in found and (role := N.clear_winner(votes[label])):
                found[label], self.reasons[label] = role, "aligned role labels"

    def missing(self, raw: list[str], found: dict[str, str]) -> list[str]:
        have = {N.effective_role(found[label], self.kind) for label in raw if label in found}
        return [r for r in N.roles(self.kind, len(raw)) if r not in have]

    def by_elimination(self, raw: list[str], found: dict[str, str]) -> None:
        left, roles = [x for x in raw if x not in found], self.missing(raw, found)
        if len(left) == len(roles) == 1:
            found[left[0]], self.reasons[left[0]] = roles[0], "the one role left"

    def profiles(self) -> dict[str, tuple[int, int, int, int]]:
        """Per label (first turn, turns, words, prompts)."""
        out: dict[str, list[int]] = {}
        for i, t in enumerate(self.turns):
            label = t["speaker_raw"].strip()
            if N.usable(label):
                said = t["final_text"] or t["zoom_text"] or t["chatgpt_text"] or t["model_text"]
                p = out.setdefault(label, [i, 0, 0, 0])
                p[1] += 1
                p[2] += len(spoken.words(said))
                p[3] += len(PROMPT.findall(said))
        return {k: tuple(v) for k, v in out.items()}

    def by_dialogue(self, raw: list[str], found: dict[str, str]) -> None:
        """Who prompts most leads; of three with an AI the one who says least supervises; the rest in order of appearance."""
        p, left, roles = self.profiles(), [x for x in raw if x not in found], self.missing(raw, found)
        lead = N.AI if N.is_ai(self.kind) else N.TEACHER

        def give(label: str, role: str, why: str) -> None:
            found[label], self.reasons[label] = role, why
            left.remove(label)
            roles.remove(role)

        if left and lead in roles:
            give(max(left, key=lambda x: (p[x][3], -p[x][0])), lead, "prompts most")
        if left and N.SUPERVISOR in roles and N.is_ai(self.kind) and len(raw) >= 3:
            give(min(left, key=lambda x: (p[x][2], p[x][1], p[x][0])), N.SUPERVISOR, "speaks least")
        for label, role in list(zip(sorted(left, key=lambda x: p[x][0]), list(roles), strict=False)):
            give(label, role, "a role left over")

    def learners_names(self, raw: list[str], found: dict[str, str]) -> None:
        """Student labels become names that the evidence supports without a tie."""
        votes: dict[str, Counter] = {label: Counter() for label in raw}

        def add(label: str, name: str | None, weight: int) -> None:
            if name and label in votes:
                votes[label][name] += weight

        own = N.human_name(self.learner_id)
        for label in raw:
            add(label, N.human_name(label), LABEL)
        if len(raw) == 1:
            add(raw[0], own, LEARNER_ID)
        for i, t in enumerate(self.turns):
            label = t["speaker_raw"].strip()
            if label not in votes:
                continue
            called: dict[str, None] = {}
            for v in self.versions(t):
                for name in N.declared(v):
                    add(label, name, SELF)
                called |= dict.fromkeys(N.addressed(v))
            after = next((x for u in self.turns[i + 1 : i + 3] if (x := u["speaker_raw"].strip()) and x != label and x in votes), None)
            for name in called if after else ():
                add(after, name, ADDRESSED)
        for name in SOURCES:
            for t, s in zip(self.turns, self.matched(name), strict=True):
                if s:
                    add(t["speaker_raw"].strip(), N.human_name(s.speaker), ALIGNED)
        students = [label for label in raw if found.get(label) == N.STUDENT]
        if len(students) == 1:
            add(students[0], own, LEARNER_ID)
        for label in students:
            if name := N.clear_winner(votes[label]):
                found[label], self.reasons[label] = name, "the learner's name"

    def resolved(self, turn: dict) -> str:
        """The turn's identity: a file's label, else what its label maps to, where a learner's own introduction counts more."""
        if kept := self.kept_label(turn):
            return kept
        now = N.identity(self.lookup(turn["speaker_raw"]) or turn["speaker"], self.kind)
        if now in (None, N.STUDENT) and (name := self.declared(turn)):
            return name
        return now or N.identity(turn["speaker_raw"], self.kind) or N.UNKNOWN

    def apply(self, mapping: dict[str, str]) -> None:
        self.mapping |= {N.squeeze(k): v for k, v in mapping.items() if N.squeeze(k)}
        for t in self.turns:
            t["speaker"] = self.resolved(t)
        self.propagate()
        for t in self.turns:
            if t["gold_speaker"]:
                t["gold_speaker"] = self.lookup(t["gold_speaker"]) or t["gold_speaker"]
        for t, s in zip(self.turns, self.matched("gold"), strict=True):
            if s:
                t["gold_speaker"] = self.lookup(s.speaker) or N.role(s.speaker, self.kind) or s.speaker or N.UNKNOWN

    def project_name(self) -> str | None:
        """The learner's name that the whole project supports without a tie."""
        votes: Counter = Counter()
        evidence = [(self.declared(t), PROJECT_SELF) for t in self.turns] + [(v, PROJECT_SAVED) for v in self.mapping.values()]
        evidence += [(t["speaker"], PROJECT_TURN) for t in self.turns] + [(self.learner_id, PROJECT_ID)]
        for value, weight in evidence:
            name = N.human_name(value) if value else None
            if name and N.role(name, self.kind) is None:
                votes[name] += weight
        return N.clear_winner(votes)

    def propagate(self) -> int:
        """The learner's name on all of the learner's turns; turns of fixed roles and files' labels stay. Returns changes."""
        name = self.project_name()
        if not name:
            return 0
        free = [t for t in self.turns if not self.kept_label(t)]
        now = {id(t): N.identity(self.lookup(t["speaker_raw"]) or t["speaker"], self.kind) for t in free}
        mine = {spoken.normalized(t["speaker_raw"]) for t in free if self.declared(t) == name or now[id(t)] in (N.STUDENT, name)}
        changed = 0
        for t in free:
            if now[id(t)] in FIXED_ROLES or N.role(t["speaker_raw"], self.kind) in FIXED_ROLES:
                continue
            gold = N.identity(t["gold_speaker"], self.kind)
            if now[id(t)] in (N.STUDENT, name) or spoken.normalized(t["speaker_raw"]) in mine or gold in (N.STUDENT, name):
                changed += t["speaker"] != name
                t["speaker"] = name
        for label, who in list(self.mapping.items()):
            form = spoken.normalized(label)
            if form in mine and form not in N.UNKNOWN_LABELS and N.identity(who, self.kind) in (None, N.STUDENT, name):
                self.mapping[label] = name
        return changed


CAST_TEXTS = ("speaker_raw", "speaker", "gold_speaker", *dict.fromkeys((*A.ANCHORS, *VERSIONS)))


def resolve(turns: DataFrame, segments: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, turn_id, speaker_raw, speaker, gold_speaker, mapping) after all stages.

    projects: project_id, conversation_type, learner_id, speaker_mapping map<string,string>.
    """
    meta = projects.select("project_id", *(F.coalesce(c, F.lit("")).alias(f"m_{c}") for c in ("conversation_type", "learner_id")), F.coalesce("speaker_mapping", F.create_map().cast("map<string,string>")).alias("m_mapping"))
    joined = turns.join(meta, "project_id", "left")

    def step(key, t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("turn_id")
        rows = [{"start": A.number(r["start"]), "end": A.number(r["end"]), **{c: A.string(r.get(c)) for c in CAST_TEXTS}} for r in t.to_dict("records")]
        if not rows:
            return pd.DataFrame(columns=["project_id", "turn_id", "speaker_raw", "speaker", "gold_speaker", "mapping"])
        first = t.iloc[0]
        cast = Cast(rows, {k: A.segments_of(g) for k, g in s.groupby("source")}, A.string(first["m_conversation_type"]), A.string(first["m_learner_id"]), dict(first["m_mapping"] or {}))
        mapping = cast.run()
        return pd.DataFrame({
            "project_id": key[0], "turn_id": t["turn_id"].to_numpy(), "speaker_raw": [r["speaker_raw"] for r in rows], "speaker": [r["speaker"] for r in rows],
            "gold_speaker": [r["gold_speaker"] for r in rows], "mapping": [mapping] * len(rows),
        })

    schema = "project_id string, turn_id int, speaker_raw string, speaker string, gold_speaker string, mapping map<string,string>"
    return spread(joined, "project_id").groupBy("project_id").cogroup(spread(segments, "project_id").groupBy("project_id")).applyInPandas(step, schema)


def profiles(turns: DataFrame) -> DataFrame:
    """(project_id, label, first_turn, turns, words, prompts) of usable raw labels, in the JVM."""
    label = F.trim(T.text("speaker_raw"))
    said = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("final_text", "zoom_text", "chatgpt_text", "model_text")), F.lit(""))
    t = turns.withColumn("label", label).withColumn("said", said).where(~T.normalized_ascii("label").isin(*T.UNKNOWN_LABELS))
    return t.groupBy("project_id", "label").agg(
        F.min("turn_id").alias("first_turn"), F.count("*").alias("turns"), F.sum(T.word_count("said").cast("long")).alias("words"),
        F.sum(F.regexp_count("said", F.lit(N.PROMPT)).cast("long")).alias("prompts"),
    )


def name_votes(turns: DataFrame) -> DataFrame:
    """(project_id, label, name, weight) that the dialogue itself supports: introductions, and names
    by which one of the next two turns of another speaker is addressed."""
    versions = T.distinct_versions(*(c for c in VERSIONS if c in turns.columns))
    t = turns.select("project_id", "turn_id", F.trim(T.text("speaker_raw")).alias("label"), versions.alias("v"))
    w = Window.partitionBy("project_id").orderBy("turn_id")
    n1, n2 = F.lead("label", 1).over(w), F.lead("label", 2).over(w)
    t = t.withColumn("next", F.when(n1 != F.col("label"), n1).when(n2 != F.col("label"), n2))
    v = t.select("project_id", "turn_id", "label", "next", F.explode("v").alias("text"))
    own = v.select("project_id", "label", F.explode(N.declared_names(F.col("text"))).alias("name"), F.lit(SELF).alias("weight"))
    called = v.where("next IS NOT NULL").select("project_id", "turn_id", F.col("next").alias("label"), F.explode(N.addressed_names(F.col("text"))).alias("name")).distinct()
    return own.unionByName(called.select("project_id", "label", "name", F.lit(ADDRESSED).alias("weight")))


def mapped(turns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Turns with `identity` from (project_id, label, identity): by the exact label, else squeezed, else normalized."""
    m = mapping.select("project_id", F.col("label").alias("l"), "identity", T.normalized_ascii("label").alias("f"))
    t = turns.withColumn("k_", F.monotonically_increasing_id())
    raw, flat, form = F.col("speaker_raw"), T.squeezed("speaker_raw"), T.normalized_ascii("speaker_raw")
    t = t.withColumn("flat_", flat).withColumn("form_", form).withColumn("raw_", raw)
    j = t.join(m, (t.project_id == m.project_id) & (t.form_ == m.f), "left").drop(m.project_id)
    rank = F.when(F.col("l") == F.col("raw_"), 0).when(F.col("l") == F.col("flat_"), 1).otherwise(2)
    best = j.groupBy("k_").agg(F.min_by("identity", F.struct(rank.alias("r"), F.col("l"))).alias("identity"))
    return t.join(best, "k_").drop("k_", "flat_", "form_", "raw_")


def display_label(raw: str = "speaker_raw", inferred: str = "speaker"):
    """The label shown: the file's if it says something, else the inferred one, else Unknown."""
    use = lambda c: F.when(~T.normalized_ascii(c).isin(*T.UNKNOWN_LABELS), T.squeezed(c))
    return F.coalesce(use(raw), use(inferred), F.lit("Unknown"))
