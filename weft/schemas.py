"""Schemas of the tables and files that the operators read, as DDL."""

VIABLE = "Identifier string, `Explicit Hs` boolean, N_Atoms int, Connectivity string, `Overlapping Atoms` boolean, Disorder boolean, SMILES string"
CAES = "entry_id string, cae_idx int, sdf string, fp_p array<double>, fp_pq array<double>, central_atom string, n_atoms int, formula_str string"
RESULTS = "task string, `3DOpt_Score` double"
TASK = (
    "task string, output_dir string, load_from_previous boolean, logging boolean, monitor_app boolean, termination_exit boolean, diversity_filter struct<run:boolean>, "
    "scoring struct<method:string,metrics:array<struct<filter:boolean,modifier:string,name:string,weight:double,parameters:map<string,string>>>>, "
    "scoring_functions array<struct<name:string,run:boolean,parameters:struct<generator:string,n_jobs:bigint,prefix:string,ref_molecule:string,save_files:boolean,timeout:bigint>>>, starting_population array<string>"
)
GENERATOR_RUN = "Target string, ccdc_sim string, ccdc_time string, ccdc_ok string, rdkit_sim string, rdkit_time string, rdkit_ok string, obabel_sim string, obabel_time string, obabel_ok string"
