"""Training-data operators: token output, fingerprints, language ID, secrets,
suffix-array dedup, mixing, decontamination, Jaccard join, LM scores, licences,
SimHash near-duplicates, filter audits, importance resampling.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
