"""The seam for models: a maker of predictors, loaded once a worker, called on batches of numpy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql.types import DataType, StructType

#: Makers by name, for settings that choose one.
PREDICTORS: dict[str, Callable[[], Callable[..., np.ndarray]]] = {}


def predictor(name: str):
    """Registers a maker under a name."""

    def add(make: Callable[[], Callable[..., np.ndarray]]):
        PREDICTORS[name] = make
        return make

    return add


def predicted(name: str, inputs: list[Column | str], kind: DataType | str, batch: int = 512, shapes: list[list[int] | None] | None = None) -> Column:
    """A model's answer for each row; ``shapes`` gives the shape of array inputs."""
    if name not in PREDICTORS:
        raise ValueError(f"unknown predictor: {name}; there are {sorted(PREDICTORS)}")
    kind = StructType.fromDDL(f"x {kind}").fields[0].dataType if isinstance(kind, str) else kind
    return predict_batch_udf(PREDICTORS[name], return_type=kind, batch_size=batch, input_tensor_shapes=shapes)(*inputs)
