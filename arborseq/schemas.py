"""Column layouts of the engine's tables."""

from pyspark.sql import types as T

LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()

CELLS = T.StructType([T.StructField("cell_id", LONG), T.StructField("cell_type", STRING)] + [T.StructField(c, DOUBLE) for c in "xyz"])
SYNAPSES = T.StructType(
    [T.StructField(c, LONG) for c in ("syn_id", "pre_cell", "post_cell")] + [T.StructField("size", LONG)] + [T.StructField(c, DOUBLE) for c in "xyz"]
)
TREE_NODES = T.StructType(
    [T.StructField(c, LONG) for c in ("cell_id", "node_id", "parent_id")]
    + [T.StructField(c, DOUBLE) for c in "xyz"]
    + [T.StructField("cell_type", STRING), T.StructField("pre_cell", LONG), T.StructField("syn_id", LONG)]
)
BRANCH_SYN = T.StructType(
    [T.StructField("post_cell", LONG), T.StructField("branch_id", LONG), T.StructField("seq_pos", T.IntegerType())]
    + [T.StructField("syn_id", LONG), T.StructField("pre_cell", LONG), T.StructField("cell_type", STRING)]
    + [T.StructField(c, DOUBLE) for c in "xyz"]
)
MIXTURE = T.StructType(
    [T.StructField("cell_id", LONG), T.StructField("comp", T.IntegerType()), T.StructField("weight", DOUBLE)]
    + [T.StructField("mean", T.ArrayType(DOUBLE)), T.StructField("cov", T.ArrayType(DOUBLE))]
)

#: Fixed type vocabulary of the domain.
EXCITATORY = ["23P", "4P", "5P-IT", "5P-ET", "5P-NP", "6P-IT", "6P-CT"]
INHIBITORY = ["BC", "MC", "BPC", "NGC"]
UNKNOWN = "Unknown"
#: The root of every tree, and the mark of a synapse without a pre-synaptic cell.
ROOT, NO_CELL = -1, -999
