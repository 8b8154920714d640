"""The tables that stages read and write, as DDL."""

RAW = (
    "repo_name string, commit_hash string, commit_datetime string, commit_message string, filename string, new_path string, change_type string, diff string, "
    "diff_parsed struct<added:array<struct<line:int,text:string>>,deleted:array<struct<line:int,text:string>>>, added_lines int, deleted_lines int, source_code string, previous_source_code string"
)
TARGETS = "array<struct<comment:string,type:string,start_line:int,end_line:int,anchor:string,status:string,prompt_code:string,prompt:string>>"
DATASET = f"file_id long, {RAW}, target_comments {TARGETS}"
KEPT = f"file_id long, repo_name string, commit_hash string, new_path string, target_comments {TARGETS}"
SCORES = "struct<bleu1:double,bleu2:double,bleu3:double,bleu4:double,rougeL:double,bertscore_f1:double>"
RESULTS = f"array<struct<result_id:long,model:string,raw_response:string,comment_text:string,error:string,scores:{SCORES}>>"
GENERATED = f"file_id long, repo_name string, commit_hash string, new_path string, comment_generations array<struct<type:string,status:string,start_line:int,end_line:int,anchor:string,comment:string,prompt_code:string,prompt:string,results:{RESULTS}>>"
PROGRESS = "repo_name string, new_path string, commit_hash string, model string, error string"
REPOSITORIES = "id long, full_name string, html_url string, default_branch string, size long, stargazers_count long"
MINED = "repo string, error string"
ANNOTATIONS = "id string, tags array<string>, notes string, done boolean, revealed boolean, updated_at string"
