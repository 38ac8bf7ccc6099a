"""quarry: hybrid retrieval and grounded-prompt assembly as Spark DataFrame jobs.

Every public operator is a ``DataFrame -> DataFrame`` function (chainable with
``df.transform``).  Sub-packages:

* ``sources``   -- table loaders, thread snapshots, CSV / JSON sources and sinks
* ``functions`` -- column-expression helpers (tokenizer, null-safe predicates,
                   vector math, size-checked broadcast)
* ``operators`` -- cleaning, statistics, chunking, indexing, search, fusion,
                   prompts, cache / memory, evaluation
* ``plans``     -- end-to-end query bindings over the driver tables
* ``streaming`` -- Structured Streaming question feed and session memory
"""

__version__ = "0.1.0"
