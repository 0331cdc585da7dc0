"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.operators import ancestry, connections, forms, genotypes, pedigrees, reconstruct, relationships, segments, unrelated
from kinloom.operators.recovery import checkpointed
from kinloom.plans import files
from kinloom.plans.oracles import SQL
from kinloom.session import ship
from kinloom.sources.overlays import view, with_views

Query = Callable[[SparkSession, str], DataFrame]


def _seg(s, d):
    return view(s, d, "ov_segments")


def _genome(s, d):
    return view(s, d, "ov_genome")


def _fam(s, d):
    return view(s, d, "ov_fam")


def _people(s, d):
    g = _genome(s, d)
    return g.select(F.explode(F.array("iid1", "iid2")).alias("iid")).distinct()


def _classes(s, d):
    return relationships.classify(_genome(s, d), relationships.synthetic_kde(s))


def _edges(s, d):
    return relationships.network_edges(_classes(s, d))


def _members(s, d):
    return relationships.networks(_people(s, d), _edges(s, d))


def _kin_classes(s, d):
    return relationships.classify(view(s, d, "ov_kin_genome"), relationships.synthetic_kde(s))


def _kin_edges(s, d):
    return relationships.network_edges(_kin_classes(s, d))


def _kin_networks(s, d):
    """Members and pairs of the families' networks, from one pass over the pairs."""
    edges = checkpointed(_kin_edges(s, d))
    return relationships.networks(view(s, d, "ov_kin_fam").where("sampled").select("iid"), edges), edges


def _all_networks(s, d):
    """Members and pairs of all networks, from one pass over the pairs."""
    edges = checkpointed(_edges(s, d))
    return relationships.networks(_people(s, d), edges), edges


def _kin_pedigrees(s, d):
    return reconstruct.reconstruct(_kin_classes(s, d), view(s, d, "ov_kin_fam").select("iid", "sex", "age"))


def _best(s, d):
    return segments.best_model(segments.models(_seg(s, d)))


def _at_locus(s, d):
    rest, parts = segments.at_locus(_seg(s, d), 6, 32_500_000)
    m = segments.models(rest, parts=parts)
    return m.select("id1", "id2", "ancestors", "meioses", "degree", F.round("lnl", 6).alias("lnl"), F.round("ll_null", 6).alias("ll_null"))


def _mask(s, d):
    return segments.merge_intervals(_seg(s, d).where("cm >= 49 and ibd = 2").select("chrom", "start_bp", (F.col("start_bp") + 8_000_000).alias("end_bp")), 1_000_000)


def _families(s, d):
    """Founders of each pedigree by sex, as two networks, and the people below them who have segments."""
    fam, seg = _fam(s, d), _seg(s, d)
    sampled = checkpointed(seg.select(F.explode(F.array("id1", "id2")).alias("iid")).distinct())
    founders = pedigrees.founders(fam).where("founder").join(fam.select("iid", "fid"), "iid").select(F.col("iid").alias("founder"), (2 * F.col("fid") + F.col("iid") % 2).cast("long").alias("network_id"))
    depth = pedigrees.ancestors(fam, sampled).join(founders.select(F.col("founder").alias("ancestor")), "ancestor", "left_semi").select(F.col("ancestor").alias("founder"), "iid", "depth")
    return founders, depth


def _degrees(s, d):
    fam = _fam(s, d)
    return pedigrees.pedigree_degrees(pedigrees.relations(fam), pedigrees.tasks_for(fam))


def _kin_links(s, d, mode="composite"):
    peds, least = view(s, d, "ov_kin_peds"), 4
    return connections.link_pedigrees(peds, connections.degree_rows(view(s, d, "ov_kin_segments"), least, tasks=pedigrees.tasks_for(peds)), least, mode=mode)


def _scored(s, d):
    founders, depth = _families(s, d)
    depth = checkpointed(depth)
    lnl, null = connections.degree_models(_seg(s, d))
    return connections.composite(connections.candidates(founders, depth, null), depth, lnl, null)


def _alternatives(s, d):
    return view(s, d, "ov_kin_peds").join(view(s, d, "ov_kin_fam").select("iid", "sex", "age"), "iid")


def _rank(s, d):
    return forms.pedigree_measures(_alternatives(s, d))


def _pcs1(s, d):
    return view(s, d, "ov_pcs").select("iid", F.element_at("pcs", 1).cast("double").alias("pc1"))


def _pcs2(s, d):
    return view(s, d, "ov_pcs").select("iid", F.element_at("pcs", 2).cast("double").alias("pc1"))


def _named(s, d):
    """Pedigrees whose people have the names they hold within their own pedigree, and those without data."""
    fam = _fam(s, d).withColumn("name", F.col("iid") - F.col("fid"))
    return fam, fam.where("name % 5 = 0").select("iid")


def _batch(col="iid"):
    return F.col(col) % 50 - F.col(col) % 2


QUERIES: dict[str, Query] = {
    "segment_pair_rollup": lambda s, d: segments.rollup(_seg(s, d)),
    "segment_degree_mle": lambda s, d: segments.best_model(segments.models(_seg(s, d))),
    "segment_degree_final": lambda s, d: segments.final_estimates(_seg(s, d), use_ibd2=True),
    "segment_degree_by_total": lambda s, d: segments.final_estimates(_seg(s, d)),
    "ascertained_models": lambda s, d: _at_locus(s, d),
    "degree_ci": lambda s, d: segments.intervals(segments.models(_seg(s, d))),
    "degree_override": lambda s, d: segments.overrides(_seg(s, d)),
    "degree_bucket_weights": lambda s, d: segments.bucket_weights(segments.models(_seg(s, d))),
    "vector_fusion": lambda s, d: relationships.fuse(_classes(s, d), segments.bucket_weights(segments.models(_seg(s, d)))),
    "control_stats": lambda s, d: segments.control_stats(_seg(s, d)),
    "overlap_density": lambda s, d: segments.overlap_density(_seg(s, d)),
    "mask_merge": _mask,
    "mask_clip": lambda s, d: segments.clip_to_mask(_seg(s, d), _mask(s, d)),
    "map_interpolate": lambda s, d: segments.map_position(_seg(s, d).select("chrom", (F.col("start_bp") + 500_000).alias("pos")), view(s, d, "ov_map")),
    "dedup_keep_last": lambda s, d: segments.keep_last(_seg(s, d), ["id1", "id2", "chrom", "start_bp"], ["cm", "ibd"]),
    "ibd2_sweep": lambda s, d: segments.ibd2_sweep(view(s, d, "ov_diploid")),
    "related_edges": lambda s, d: relationships.related_edges(_genome(s, d)),
    "relationship_class": _classes,
    "mz_pairs": lambda s, d: _classes(s, d).where("mz").select("iid1", "iid2"),
    "family_networks": _members,
    "network_density": lambda s, d: relationships.density(*_all_networks(s, d)),
    "max_unrelated_set": lambda s, d: unrelated.unrelated_sets(*_all_networks(s, d), relationships.fold_traits(view(s, d, "ov_traits")).select("iid", "affected")),
    "unrelated_by_traits": lambda s, d: unrelated.unrelated_sets(*_kin_networks(s, d), view(s, d, "ov_kin_fam").select("iid", "age", F.when(F.col("iid") % 3 == 0, 1).otherwise(0).alias("case")), (("case", "high"), ("age", "low_average"), ("", "size"))),
    "unrelated_methods": lambda s, d: unrelated.method_sets(*_kin_networks(s, d), view(s, d, "ov_kin_fam").select("iid", F.when(F.col("iid") % 3 == 0, 1).otherwise(0).alias("affected"))),
    "trait_fold": lambda s, d: relationships.fold_traits(view(s, d, "ov_traits")),
    "pedigree_relations": lambda s, d: pedigrees.relations(_fam(s, d)),
    "relation_table": lambda s, d: pedigrees.relation_table(pedigrees.relations(_fam(s, d))),
    "network_relations": lambda s, d: forms.relations_across(_alternatives(s, d)),
    "generation_steps": lambda s, d: forms.generation_steps(view(s, d, "ov_kin_fam")),
    "pedigree_degrees": _degrees,
    "ancestor_closure": lambda s, d: pedigrees.ancestors(_fam(s, d)),
    "genetic_relatives": lambda s, d: pedigrees.relatives(_fam(s, d)),
    "founders_leafs": lambda s, d: pedigrees.founders(_fam(s, d)),
    "generation_levels": lambda s, d: pedigrees.generations(_fam(s, d)),
    "age_flags": lambda s, d: pedigrees.age_flags(pedigrees.relations(_fam(s, d)), _fam(s, d)),
    "sex_conflicts": lambda s, d: pedigrees.sex_conflicts(_fam(s, d)),
    "pedigree_score": lambda s, d: pedigrees.pedigree_scores(pedigrees.relations(_fam(s, d)), relationships.densities(_genome(s, d), relationships.synthetic_kde(s)), _fam(s, d)),
    "pedigree_rank": lambda s, d: pedigrees.rank_pedigrees(_rank(s, d), ["network_id"]),
    "score_summary": lambda s, d: pedigrees.score_summary(_rank(s, d), ["network_id"]),
    "unnecessary_placeholders": lambda s, d: pedigrees.unnecessary_placeholders(_fam(s, d), _fam(s, d).where("iid % 5 <> 0").select("iid")),
    "reconstruct_pedigrees": _kin_pedigrees,
    "pedigree_recovery": lambda s, d: reconstruct.recovered(_kin_pedigrees(s, d), view(s, d, "ov_kin_fam").where("sampled").select("iid", "pid", "mid")),
    "pedigree_cutoffs": lambda s, d: _kin_pedigrees(s, d).select("network_id", "status", "cutoff").distinct(),
    "degree_lnl": lambda s, d: connections.degree_lnl(segments.models(_seg(s, d))),
    "connection_composite": _scored,
    "connection_best": lambda s, d: connections.best_connections(_scored(s, d)),
    "pedigree_links": _kin_links,
    "pedigree_links_aic": lambda s, d: _kin_links(s, d, "aic"),
    "connection_significance": lambda s, d: connections.pair_significance(segments.best_model(segments.models(_seg(s, d)))),
    "bonferroni": lambda s, d: connections.corrected_level(_families(s, d)[0], relationships.dataset_summary(*_all_networks(s, d)).first()["n_unrelated"]),
    "variant_dups": lambda s, d: genotypes.duplicates(view(s, d, "ov_variants")),
    "variants_once": lambda s, d: genotypes.without_duplicates(view(s, d, "ov_variants")),
    "all_founders": lambda s, d: genotypes.without_parents(_fam(s, d)).select("iid", "pid", "mid", "sex"),
    "unrelated_samples": lambda s, d: genotypes.unrelated_samples(view(s, d, "ov_genotypes"), geno=0.2, mind=0.2),
    "autosomes": lambda s, d: genotypes.autosomes(view(s, d, "ov_variants")),
    "strand_flip": lambda s, d: genotypes.strand_actions(view(s, d, "ov_variants"), view(s, d, "ov_ref_variants")),
    "thin_variants": lambda s, d: genotypes.thin_by_distance(view(s, d, "ov_variants")),
    "allele_freq": lambda s, d: genotypes.frequencies(view(s, d, "ov_genotypes")),
    "sample_stats": lambda s, d: genotypes.sample_stats(view(s, d, "ov_genotypes")),
    "genotype_qc": lambda s, d: genotypes.cleaned(view(s, d, "ov_genotypes"), geno=0.2),
    "ibs_pairs": lambda s, d: genotypes.ibs_pairs(view(s, d, "ov_genotypes")),
    "aim_scan": lambda s, d: genotypes.aim_scan(view(s, d, "ov_genotypes"), _pcs1(s, d)),
    "haploid_match": lambda s, d: genotypes.haploid_match(view(s, d, "ov_haploid"), 0.3, 0.2),
    "ancestry_split": lambda s, d: ancestry.split(view(s, d, "ov_pcs")),
    "ancestry_scale": lambda s, d: ancestry.scaled(view(s, d, "ov_pcs")),
    "admixture_flag": lambda s, d: ancestry.admixture(view(s, d, "ov_pcs").where("is_ref").withColumn("batch", _batch()), group=("batch",)),
    "ibd2_table": lambda s, d: segments.ibd2_table(_seg(s, d), view(s, d, "ov_diploid")),
    "sibling_override": lambda s, d: segments.sibling_overrides(_seg(s, d)),
    "ascertained_split": lambda s, d: segments.split_at_locus(_seg(s, d), 6, 32_500_000),
    "twin_nodes": lambda s, d: relationships.twin_nodes(_classes(s, d)),
    "network_edges": _edges,
    "network_pairs": lambda s, d: relationships.network_pairs(*_all_networks(s, d)),
    "sample_relatedness": lambda s, d: relationships.sample_relatedness(_best(s, d), _members(s, d)),
    "dataset_summary": lambda s, d: relationships.dataset_summary(*_all_networks(s, d)),
    "possibility_counts": lambda s, d: relationships.possibility_counts(_classes(s, d), _members(s, d)),
    "attribute_gaps": lambda s, d: relationships.attribute_gaps(_people(s, d), view(s, d, "ov_traits").where("btrait <> 0")),
    "known_networks": lambda s, d: relationships.known_networks(_members(s, d), _fam(s, d).where("age > 80")),
    "reference_samples": lambda s, d: ancestry.reference_samples(view(s, d, "ov_pcs"), s.createDataFrame([("CEU",), ("ASW",), ("JP",)], "pop string")),
    "markers_to_remove": lambda s, d: genotypes.markers_to_remove(view(s, d, "ov_genotypes"), [_pcs1(s, d), _pcs2(s, d)], 1.5),
    "merge_with_reference": lambda s, d: genotypes.merge_with_reference(view(s, d, "ov_genotypes").where("iid % 2 = 1"), view(s, d, "ov_genotypes").where("iid % 2 = 0"), genotypes.strand_actions(view(s, d, "ov_variants"), view(s, d, "ov_ref_variants")), 0.2),
    "subpedigrees": lambda s, d: forms.subpedigrees(_fam(s, d)),
    "maternal_conflicts": lambda s, d: forms.haploid_conflicts(_fam(s, d), genotypes.haploid_match(view(s, d, "ov_haploid"), unknown=0.99)),
    "paternal_conflicts": lambda s, d: forms.haploid_conflicts(_fam(s, d), genotypes.haploid_match(view(s, d, "ov_haploid"), unknown=0.99), "pid"),
    "inferred_sexes": lambda s, d: forms.inferred_sexes(_fam(s, d).withColumn("sex", F.when(F.col("iid") % 3 == 0, 0).otherwise(F.col("sex")))),
    "pruned_pedigrees": lambda s, d: forms.pruned(*_named(s, d)),
    "pedigree_forms": lambda s, d: forms.form_classes(forms.pedigree_forms(*_named(s, d), "name")),
    "expected_pedigrees": lambda s, d: forms.expected_matches(_named(s, d)[0], _named(s, d)[0].where("fid = 0"), _named(s, d)[0].where("name % 5 <> 0").select("name")),
    "unresolved_relatives": lambda s, d: relationships.unresolved_relatives(_edges(s, d), _degrees(s, d)),
    "null_exceedances": lambda s, d: segments.null_exceedances(_seg(s, d), 2),
    "ld_prune": lambda s, d: genotypes.ld_prune(view(s, d, "ov_variants"), view(s, d, "ov_genotypes")),
    "genotype_components": lambda s, d: genotypes.genotype_components(view(s, d, "ov_genotypes")),
    "analysis_branch": lambda s, d: genotypes.analysis_branch(ancestry.admixture(view(s, d, "ov_pcs").where("is_ref").withColumn("batch", _batch()), group=("batch",)), view(s, d, "ov_pcs").where("not is_ref").select(_batch().alias("batch"), "iid")),
    "ancestry_probabilities": lambda s, d: ancestry.probabilities(view(s, d, "ov_pcs")),
    "ancestry_folds": lambda s, d: ancestry.cross_validated(view(s, d, "ov_pcs")),
    "ancestry_predict": lambda s, d: ancestry.predict(view(s, d, "ov_pcs")),
}


def _ready(query: Query) -> Query:
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {name: _ready(q) for name, q in (QUERIES | files.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
