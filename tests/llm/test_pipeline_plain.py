"""The whole pipeline against a plain one: loops over lists in place of plans."""

import hashlib
import math
import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline
from linkloom.llm import bpe, queries, soft_mixing
from linkloom.llm import compression_quality as cq
from linkloom.llm import quality_rules as qr
from tests.llm.test_mixing_and_pipeline import plain_rates
from tests.llm.test_near_copies import grouped, plain_set
from tests.llm.test_quality import plain_counts

SF = "/root/testdata/sf0.001"


def plain_rules(docs):
    counts = [dict(zip(qr.COUNTS, plain_counts(d.text), strict=True)) for d in docs]
    failed = [c["n_words"] < qr.MIN_WORDS or 100 * c["n_repeat_words"] > 50 * c["n_words"] for c in counts]
    ratios = [{name: math.floor(1000 * c[top] / max(c[under], 1)) for name, top, under, *_ in qr.RATIOS} for c in counts]
    held = defaultdict(list)
    for d, bad, r in zip(docs, failed, ratios, strict=True):
        if not bad:
            for name, x in r.items():
                drop = max(x.bit_length() - 5, 0)
                for key in ((d.lang, d.source), (d.lang,), ()):
                    held[key, name].append(x >> drop << drop)

    def kept(d, bad, r):
        if bad:
            return False
        for name, _, _, least, both in qr.RATIOS:
            sets = [held[key, name] for key in ((d.lang, d.source), (d.lang,), ())]

            def share(k, sets=sets):
                own, lang, whole = (sum(v <= k for v in values) for values in sets)
                parent = (lang + qr.GROUP * (whole / len(sets[2]))) / (len(sets[1]) + qr.GROUP)
                return (own + qr.GROUP * parent) / (len(sets[0]) + qr.GROUP)

            shares = [(k, share(k)) for k in sorted(set(sets[2]))]
            q25, q50, q75 = (min(k for k, f in shares if f >= q) for q in (0.25, 0.5, 0.75))
            if r[name] > q75 + qr.REACH * max(q75 - q50, least) or both and r[name] < q25 - qr.REACH * max(q50 - q25, least):
                return False
        return True

    return [d for d, bad, r in zip(docs, failed, ratios, strict=True) if kept(d, bad, r)]


def test_pipeline_equals_the_plain_one(spark):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = cq.fit(table, labels)
    packers = model.packers()
    docs = [d for d in table.collect() if model.score(np.array([cq.features(d.text.encode(), packers)]))[0] >= 0.5]
    docs = plain_rules(docs)
    docs = [d for d, (i, least) in zip(docs, grouped([(d.doc_id, plain_set(d.text)) for d in docs]), strict=True) if least == i]
    domains = list(queries.TARGETS)
    classifier = soft_mixing.fit_classifier(queries.labelled_domains(spark.createDataFrame(docs, table.schema)), domains)
    p = np.array([classifier.posterior(d.text.encode()) for d in docs])
    n = np.array([float(len(d.text.encode().split())) for d in docs])
    rates = plain_rates(p, n, np.array(list(queries.TARGETS.values())) * n.sum())
    dice = [(xxhash.xxh64_intdigest(struct.pack("<q", d.doc_id), 42) >> 11) / 2**53 for d in docs]
    copies = [math.floor(r + u) for r, u in zip(rates, dice, strict=True)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.BYTE_RANKS), special_tokens={})
    want = []
    for d, k in zip(docs, copies, strict=True):
        ids = np.array(library.encode_ordinary(d.text), "<u4").tobytes()
        want += [(d.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())] * k
    got = [tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want) and len(got) > 50
