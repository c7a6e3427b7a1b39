"""One versioned bundle of all that scoring needs: classifier, smoother, label scheme and epoch length, in one text file with a digest that is checked on load."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import bagging, network, score, sequence

FORM = 1


@dataclass
class Bundle:
    """classifier: a Forest of bagging, (weights, shape) of a network, or the name of a scorer without a model."""

    classifier: bagging.Forest | tuple[network.Weights, network.Shape] | str
    scheme: str
    epoch_s: float = 30.0
    smoother: sequence.HiddenMarkov | None = None
    version: str = "1"

    @property
    def labels(self) -> list[str]:
        return score.SCHEMES[self.scheme]

    def scorer(self) -> Callable[[DataFrame], DataFrame]:
        """Adds label, and probability where the classifier has one, to windows."""
        if isinstance(self.classifier, str):
            return score.load(self.classifier, self.scheme)
        if isinstance(self.classifier, tuple):
            return network.scorer(*self.classifier)
        key = ["subject_id", "epoch_us"]
        return lambda w: bagging.predict(self.classifier, score.array_features(w), key, out="label").drop("trees")

    def to_text(self) -> str:
        c = self.classifier
        if isinstance(c, tuple):
            body = {"kind": "network", "shape": asdict(c[1]), "weights": {k: [list(v.shape), base64.b64encode(np.ascontiguousarray(v, "<f8").tobytes()).decode()] for k, v in c[0].items()}}
        else:
            body = {"kind": "named", "name": c} if isinstance(c, str) else {"kind": "balanced", "forest": json.loads(c.to_json())}
        text = json.dumps({"classifier": body, "scheme": self.scheme, "epoch_s": self.epoch_s, "version": self.version, "smoother": self.smoother.to_json() if self.smoother else None}, sort_keys=True)
        return json.dumps({"form": FORM, "sha256": hashlib.sha256(text.encode()).hexdigest()}) + "\n" + text

    @classmethod
    def from_text(cls, text: str) -> Bundle:
        """An unknown form or a digest that differs is an error."""
        try:
            head, body = text.split("\n", 1)
            head = json.loads(head)
            form, digest = head["form"], head["sha256"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("not a bundle") from e
        if form != FORM:
            raise ValueError(f"a bundle of form {form}; this reads {FORM}")
        if hashlib.sha256(body.encode()).hexdigest() != digest:
            raise ValueError("the bundle is damaged: its digest differs")
        d = json.loads(body)
        c = d["classifier"]
        if c["kind"] == "network":
            shape = network.Shape(**{k: tuple(v) if isinstance(v, list) else v for k, v in c["shape"].items()})
            made = ({k: np.frombuffer(base64.b64decode(raw), "<f8").reshape(size) for k, (size, raw) in c["weights"].items()}, shape)
        else:
            made = c["name"] if c["kind"] == "named" else bagging.Forest.from_json(json.dumps(c["forest"]))
        return cls(made, d["scheme"], d["epoch_s"], sequence.HiddenMarkov.from_json(d["smoother"]) if d["smoother"] else None, d["version"])


def save(spark: SparkSession, made: Bundle, path: str) -> None:
    """A folder with one text file; what lies there is replaced."""
    lines = made.to_text().split("\n")
    spark.createDataFrame(list(enumerate(lines)), "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Bundle:
    rows = spark.read.option("wholetext", True).text(path).select(F.col("value")).collect()  # one model
    return Bundle.from_text("\n".join(r["value"] for r in rows).rstrip("\n"))
