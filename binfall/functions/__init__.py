from .bucketing import Config
from .rowconfig import RowConfig, same_parameters
from .width import U32, U64, CounterWidth

__all__ = ["U32", "U64", "Config", "CounterWidth", "RowConfig", "same_parameters"]
