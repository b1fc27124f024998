"""Grounded-text evaluation as PySpark DataFrame operators.

``functions``  column expressions (text clean-up, prompts, replies, arrays)
``operators``  DataFrame -> DataFrame steps (samples, transcripts, graphs, scores)
``sources``    annotation files, task files, lexicons, images, sinks
``plans``      whole jobs put together from the operators, and the query catalogue
"""

__version__ = "0.1.0"
