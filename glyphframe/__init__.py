"""Recognition data analytics on PySpark: corpora, evaluation, boxes, layout and training plans as DataFrame operators."""
