"""Registered queries of the machine-identity operators, and the same in SQL.

Detection queries run over the derived corpus; their SQL starts from the order keys, which say what was planted,
and knows no pattern. Relational queries start from rows that both engines derive from the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.functions import secrets as S
from idlens.functions import text as X
from idlens.functions.catalog import rule_rows
from idlens.operators import baseline as B
from idlens.operators import correlate as C
from idlens.operators import detect as D
from idlens.operators import identities as I
from idlens.operators import reports as A
from idlens.operators import rules as R
from idlens.plans import corpus, synthetic
from idlens.plans.scan import scan
from idlens.sources import artifacts as src
from idlens.sources import store
from idlens.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A fixed key, so that fingerprints compare between engines.
KEY = b"idlens registered queries"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def by_rule(signals: DataFrame) -> DataFrame:
    return signals.groupBy("repo", "rule_id").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def by_signal(signals: DataFrame) -> DataFrame:
    """Signals of one kind of file read alike, so that they are counted by all they say."""
    said = ["repo", "rule_id", "line_no", "name", "provider", "confidence", F.array_join("tags", ",").alias("tags")]
    return signals.groupBy(*said).agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


# What each kind of file of the corpus must yield, and nothing else:
# detector | kind | line | rule | name | provider | confidence | tags.
PLANTED = [
    tuple(x.strip() for x in row.split("|"))
    for row in """
env | 0 | 2 | nhi_plaintext_env_secret | PAY_TOKEN | - | medium | plaintext_secret,env_secret
env | 0 | 3 | nhi_cloud_key_detected | AWS_ACCESS_KEY_ID | aws | high | plaintext_secret,env_secret
vendor | 0 | 3 | nhi_cloud_key_detected | AWS_ACCESS_KEY_ID | aws | high | plaintext_secret,modern_saas
config | 2 | 2 | nhi_hardcoded_secret | password | - | medium | plaintext_secret,hardcoded_secret
config | 3 | 1 | nhi_hardcoded_secret | service.api_key | - | medium | plaintext_secret,hardcoded_secret
ci | 4 | 1 | nhi_github_actions_write_all | GitHub Actions workflow token | github | high | ci_cd,broad_permissions
ci | 4 | 5 | nhi_github_actions_unpinned_action | acme/ship | github | medium | ci_cd,third_party,unpinned
ci | 4 | 7 | nhi_github_actions_expression_injection | Untrusted expression in run step | github | medium | ci_cd,expression_injection
ci | 5 | 2 | nhi_gitlab_ci_plaintext_variable | DEPLOY_TOKEN | gitlab | medium | ci_cd,gitlab,plaintext_secret
config | 5 | 2 | nhi_hardcoded_secret | DEPLOY_TOKEN | - | medium | plaintext_secret,hardcoded_secret
iac | 6 | 2 | nhi_plaintext_env_secret | Docker secret variable | - | medium | docker,plaintext_secret
iac | 6 | 3 | nhi_docker_remote_script_execution | Remote script piped to shell | - | medium | docker,remote_script
iac | 7 | 2 | nhi_cloud_admin_policy | Broad Terraform IAM policy | cloud | medium | cloud,admin_policy
iac | 7 | 4 | nhi_cloud_key_detected | Terraform cloud credential | cloud | high | cloud,plaintext_secret
iac | 8 | 4 | nhi_overprivileged_nhi | Host namespaces | kubernetes | medium | kubernetes,host_namespaces
windowed | 8 | 9 | nhi_kubernetes_env_plaintext_secret | DB_PASSWORD | kubernetes | medium | kubernetes,plaintext_secret
config | 9 | 2 | nhi_hardcoded_secret | token | - | medium | plaintext_secret,hardcoded_secret
agents | 10 | 1 | nhi_ai_agent_shell_access | agents | - | medium | ai_agent
ai | 10 | 2 | nhi_rag_context_to_tool_bridge | RAG context to tool bridge | - | medium | rag,untrusted_context,tool_bridge
mcp | 12 | 1 | nhi_mcp_package_install_without_pinning | MCP unpinned server source | - | high | mcp,supply_chain,unpinned
mcp | 12 | 1 | nhi_mcp_server_high_risk_tool_access | MCP high-risk server | - | high | mcp,high_risk_tools
ai | 13 | 2 | nhi_prompt_artifact_prompt_injection | prompt instruction | - | high | prompt_artifact,untrusted_context,prompt_injection
ai | 13 | 2 | nhi_prompt_artifact_system_prompt_leakage | system prompt leakage request | - | high | prompt_artifact,untrusted_context,system_prompt_leakage
registry | 14 | 1 | nhi_npm_registry_token_in_npmrc | //registry.example.org/:_authToken | npm | high | npm,package_registry,publish_token,supply_chain
vendor | 14 | 1 | nhi_encoded_registry_auth_detected | Package registry auth | package registry | medium | plaintext_secret,package_registry
host | 15 | 1 | nhi_linux_pam_absolute_module_path | PAM absolute module path | - | high | linux_auth,pam,absolute_module_path
host | 15 | 1 | nhi_linux_pam_auth_chain_modified | PAM auth chain modified | - | high | linux_auth,pam,auth_chain
host | 15 | 1 | nhi_linux_pam_module_outside_trusted_dir | PAM module outside trusted directory | - | high | linux_auth,pam,persistence_path
host | 15 | 1 | nhi_linux_pam_unknown_module | Unknown PAM module reference | - | medium | linux_auth,pam,unknown_module
ci | 16 | 3 | nhi_ci_unpinned_component | acme/tool | circleci | medium | ci_cd,circleci,third_party,unpinned
ci | 16 | 7 | nhi_overprivileged_nhi | CircleCI privileged executor | circleci | medium | ci_cd,circleci,privileged
ci | 16 | 9 | nhi_hardcoded_secret | API_TOKEN | circleci | medium | ci_cd,circleci,plaintext_secret
ci | 16 | 10 | nhi_circleci_context_usage | CircleCI context secrets attached | circleci | low | ci_cd,circleci,context
config | 16 | 9 | nhi_hardcoded_secret | API_TOKEN | - | medium | plaintext_secret,hardcoded_secret
ci | 17 | 2 | nhi_jenkins_credentials_binding | TOKEN_ID | jenkins | low | ci_cd,jenkins,credential_binding
ci | 17 | 3 | nhi_hardcoded_secret | DB_PASSWORD | jenkins | medium | ci_cd,jenkins,plaintext_secret
ci | 17 | 4 | nhi_jenkins_credentials_binding | Jenkins withCredentials binding | jenkins | low | ci_cd,jenkins,credential_binding
ci | 17 | 5 | nhi_ci_remote_script_execution | Remote script piped to shell in CI step | jenkins | medium | ci_cd,jenkins,remote_script
ci | 18 | 3 | nhi_ci_cd_broad_permissions | Azure Pipelines persistCredentials | azure devops | medium | ci_cd,azure_pipelines,broad_permissions
ci | 18 | 4 | nhi_ci_cd_broad_permissions | Azure Pipelines System.AccessToken | azure devops | medium | ci_cd,azure_pipelines,broad_permissions
ci | 19 | 5 | nhi_ci_unpinned_component | acme/push:latest | bitbucket | medium | ci_cd,bitbucket,third_party,unpinned
ci | 20 | 4 | nhi_gitlab_ci_dind_privileged | GitLab CI docker-in-docker service | gitlab | medium | ci_cd,gitlab,privileged
ci | 20 | 8 | nhi_gitlab_ci_debug_trace_enabled | GitLab CI debug tracing enabled | gitlab | high | ci_cd,gitlab,secret_exposure
ci | 20 | 11 | nhi_gitlab_ci_job_token_exposure | $CI_JOB_TOKEN forwarded to triggered pipeline | gitlab | medium | ci_cd,gitlab,token_exposure
ci | 20 | 12 | nhi_gitlab_ci_oidc_id_token | GitLab OIDC id_token | gitlab | medium | ci_cd,gitlab,oidc
ci | 20 | 14 | nhi_gitlab_ci_vault_secrets | GitLab Vault secrets binding | gitlab | medium | ci_cd,gitlab,vault
ci | 20 | 17 | nhi_gitlab_ci_unprotected_environment | GitLab unprotected deployment environment | gitlab | medium | ci_cd,gitlab,unprotected_environment
ci | 20 | 18 | nhi_gitlab_ci_deployment_without_protected_check | GitLab deployment without protected-branch gate | gitlab | medium | ci_cd,gitlab,missing_gate
config | 21 | 2 | nhi_hardcoded_secret | dbPassword | - | medium | plaintext_secret,hardcoded_secret
iac | 21 | 2 | nhi_helm_values_plaintext_secret | dbPassword | helm | medium | helm,values_yaml,plaintext_secret
iac | 22 | 2 | nhi_pulumi_config_plaintext_secret | app:dbPassword | pulumi | medium | pulumi,iac,plaintext_secret
iac | 23 | 6 | nhi_bicep_param_default_plaintext_secret | apiKey | azure | medium | bicep,iac,plaintext_secret
windowed | 23 | 1 | nhi_bicep_param_missing_secure_decorator | adminPassword | azure | high | bicep,iac,missing_secure
windowed | 23 | 6 | nhi_bicep_param_missing_secure_decorator | apiKey | azure | high | bicep,iac,missing_secure
windowed | 24 | 3 | nhi_pypi_token_in_pypirc | [pypi] password | pypi | high | pypi,package_registry,publish_token,supply_chain
windowed | 25 | 3 | nhi_netrc_credential | m.example:bob | netrc | high | netrc,package_registry,supply_chain
nested_secrets | 26 | 1 | nhi_terraform_state_plaintext_secret | resources[0].instances[0].attributes.deep.deeper.still[0].at.last.password | aws | medium | terraform_state,iac,plaintext_secret
config | 27 | 1 | nhi_hardcoded_secret | context.dbPassword | - | medium | plaintext_secret,hardcoded_secret
nested_secrets | 27 | 1 | nhi_aws_cdk_context_secret | context.dbPassword | aws | medium | aws_cdk,iac,plaintext_secret
documents_settings | 28 | 1 | nhi_environment_isolation_failure | npm script deploy | - | medium | package,deployment
documents_settings | 28 | 1 | nhi_hardcoded_secret | npm script login | - | medium | package,plaintext_secret
documents_settings | 28 | 1 | nhi_npm_script_remote_execution | npm script setup | - | medium | package,remote_script
config | 29 | 1 | nhi_hardcoded_secret | hostRules[0].token | - | medium | plaintext_secret,hardcoded_secret
documents_settings | 29 | 1 | nhi_renovate_automerge_enabled | Renovate bot | renovate | medium | bot,renovate,automerge
documents_settings | 29 | 1 | nhi_renovate_bot_identity | Renovate bot | renovate | medium | bot,renovate
documents_settings | 29 | 1 | nhi_renovate_extends_github_preset | Renovate bot | renovate | medium | bot,renovate,third_party
documents_settings | 29 | 1 | nhi_renovate_host_rules_plaintext_token | Renovate host rule token | renovate | medium | bot,renovate,plaintext_secret
documents_settings | 29 | 1 | nhi_renovate_vulnerability_alerts_disabled | Renovate bot | renovate | medium | bot,renovate,alerts_disabled
documents_settings | 30 | 2 | nhi_dependabot_bot_identity | Dependabot | github | medium | bot,dependabot
documents_settings | 30 | 4 | nhi_dependabot_targets_protected_branch | Dependabot | github | medium | bot,dependabot,protected_branch
documents_settings | 31 | 1 | nhi_browser_extension_broad_host_background | Helper | - | high | browser_extension,broad_permissions,background_script
documents_settings | 31 | 1 | nhi_browser_extension_risky_permissions | Helper | - | medium | browser_extension,broad_permissions
documents_settings | 32 | 1 | nhi_broad_oauth_scope | oauth_client | - | medium | oauth,broad_scope
registry | 33 | 2 | nhi_gradle_repository_credential | repoPassword | gradle | high | gradle,package_registry,publish_token,supply_chain
registry | 34 | 1 | nhi_hardcoded_secret | git.example.org | git | high | git,credential_store,supply_chain
vendor | 35 | 1 | nhi_webhook_missing_signature_protection | Webhook without signature check | slack | medium | webhook,missing_signature
vendor | 35 | 1 | nhi_webhook_secret_exposed | Webhook URL | slack | high | webhook,plaintext_secret
vendor | 35 | 2 | nhi_webhook_missing_signature_protection | Webhook without signature check | - | medium | webhook,missing_signature
vendor | 35 | 2 | nhi_webhook_secret_exposed | Webhook URL | - | medium | webhook,plaintext_secret
ai | 36 | 2 | nhi_llm_output_exec_sink | Model output executed | - | high | ai_code_flow,llm_output,privileged_sink
ai | 36 | 3 | nhi_llm_output_shell_sink | Model output in shell | - | high | ai_code_flow,llm_output,privileged_sink
ai | 36 | 4 | nhi_llm_output_sql_sink | Model output in SQL | - | high | ai_code_flow,llm_output,privileged_sink
ai | 36 | 5 | nhi_llm_output_html_sink | Model output in HTML | - | high | ai_code_flow,llm_output,privileged_sink
ai | 36 | 6 | nhi_model_trust_remote_code | trust_remote_code model load | - | high | model_supply_chain,remote_code
ai | 36 | 6 | nhi_model_unpinned_revision | unpinned model revision | - | medium | model_supply_chain,unpinned_model
ai | 37 | 1 | nhi_ai_provider_unbounded_consumption | AI provider consumption controls | - | medium | ai_provider,unbounded_consumption
ai | 37 | 1 | nhi_model_gateway_unlogged_routing | model gateway logging | - | medium | model_gateway,ai_gateway
ai | 37 | 2 | nhi_model_provider_fallback_without_policy | provider fallback policy | - | medium | model_gateway,provider_fallback
agents | 38 | 1 | nhi_ai_agent_framework_detected | index | - | medium | ai_agent
ai | 38 | 1 | nhi_rag_no_access_filter | RAG access filter | - | medium | rag,untrusted_context,missing_filter
ai | 38 | 1 | nhi_rag_poisoning_surface | RAG poisoning surface | - | medium | rag,untrusted_context,poisoning_surface
ai | 38 | 1 | nhi_rag_untrusted_source_ingestion | RAG ingestion | - | medium | rag,untrusted_context,external_content
ai | 38 | 1 | nhi_vector_store_cross_tenant_risk | Vector store tenant isolation | - | medium | rag,untrusted_context,cross_tenant
vendor | 39 | 1 | nhi_package_registry_token_detected | NPM_TOKEN | npm | high | plaintext_secret,modern_saas
vendor | 39 | 2 | nhi_github_token_detected | GITHUB_FINE_GRAINED_TOKEN | github | high | plaintext_secret,modern_saas
vendor | 39 | 3 | nhi_github_token_detected | GITHUB_CLASSIC_TOKEN | github | high | plaintext_secret,modern_saas
vendor | 39 | 4 | nhi_secret_leakage | GITLAB_PAT | gitlab | medium | plaintext_secret,modern_saas
vendor | 39 | 5 | nhi_ai_provider_key_detected | HUGGINGFACE_TOKEN | hugging face | high | plaintext_secret,modern_saas
vendor | 39 | 6 | nhi_ai_provider_key_detected | ANTHROPIC_API_KEY | anthropic | high | plaintext_secret,modern_saas
vendor | 39 | 7 | nhi_payment_key_detected | STRIPE_SECRET_KEY | stripe | high | plaintext_secret,modern_saas
vendor | 39 | 8 | nhi_deployment_platform_token_detected | VERCEL_TOKEN | vercel | high | plaintext_secret,modern_saas
vendor | 39 | 9 | nhi_cloud_key_detected | CLOUDFLARE_API_TOKEN | cloudflare | high | plaintext_secret,modern_saas
vendor | 39 | 10 | nhi_cloud_key_detected | AZURE_STORAGE_ACCOUNT_KEY | azure | high | plaintext_secret,modern_saas
ci | 40 | 1 | nhi_github_actions_pull_request_target_secrets | pull_request_target secret exposure | github | high | ci_cd,secret_exposure
ci | 40 | 4 | nhi_github_actions_self_hosted_runner | Self-hosted GitHub Actions runner | github | medium | ci_cd,self_hosted_runner
ci | 40 | 6 | nhi_github_actions_unpinned_action | actions/checkout | github | low | ci_cd,third_party,unpinned,first_party
ci | 40 | 8 | nhi_github_actions_prt_untrusted_checkout | pull_request_target checks out PR head | github | high | ci_cd,untrusted_checkout
ci | 40 | 9 | nhi_ci_deployment_without_approval | CI/CD deployment identity | github | high | ci_cd,deployment_path
ci | 40 | 9 | nhi_environment_isolation_failure | Production deployment secrets | github | medium | ci_cd,production
ci | 40 | 12 | nhi_github_actions_secrets_inherit | Reusable workflow inherits all secrets | github | medium | ci_cd,secret_exposure
host | 41 | 1 | nhi_linux_pam_antiforensics_indicators | PAM/SSH anti-forensics indicator | - | high | linux_auth,pam,antiforensics
host | 41 | 2 | nhi_linux_pam_auth_chain_modified | Script modifies PAM authentication chain | - | high | linux_auth,pam,auth_chain,deployment_script
host | 41 | 3 | nhi_linux_pam_auth_chain_modified | SSH UsePAM disabled | - | medium | linux_auth,pam,sshd_config,pam_bypass
iac | 42 | 2 | nhi_secret_leakage | Kubernetes Secret object | kubernetes | medium | kubernetes,secret_object
iac | 42 | 3 | nhi_kubernetes_automount_token | Kubernetes automounted token | kubernetes | medium | kubernetes
iac | 42 | 4 | nhi_kubernetes_cluster_admin | Kubernetes cluster-admin | kubernetes | high | kubernetes,cluster_admin
iac | 42 | 5 | nhi_docker_privileged_container | Host path mount | kubernetes | medium | kubernetes,host_access
iac | 42 | 7 | nhi_docker_privileged_container | Privileged pod | kubernetes | medium | kubernetes,privileged
iac | 42 | 8 | nhi_overprivileged_nhi | Container runs as root | kubernetes | medium | kubernetes,root_user
ai | 43 | 3 | nhi_model_container_unpinned_digest | model serving image | - | medium | model_supply_chain,container
ai | 43 | 3 | nhi_model_gateway_unlogged_routing | model gateway logging | - | medium | model_gateway,ai_gateway
iac | 43 | 3 | nhi_model_gateway_detected | Docker model gateway service | - | high | model_gateway,docker
iac | 43 | 4 | nhi_docker_privileged_container | Privileged container | - | medium | docker,privileged
iac | 43 | 6 | nhi_docker_socket_mount | Docker socket mount | - | high | docker,host_access
mcp | 44 | 1 | nhi_mcp_env_secret_passthrough | MCP secret environment passthrough | - | high | mcp,plaintext_secret
mcp | 44 | 1 | nhi_mcp_remote_script_execution | MCP remote script execution | - | high | mcp,supply_chain,remote_script
mcp | 44 | 1 | nhi_mcp_remote_server | MCP remote server | - | high | mcp,remote_server
mcp | 44 | 1 | nhi_mcp_server_high_risk_tool_access | MCP high-risk server | - | high | mcp,high_risk_tools
mcp | 44 | 1 | nhi_mcp_unsafe_runtime_flag | MCP unsafe runtime flag | - | high | mcp,unsafe_runtime
mcp | 44 | 1 | nhi_secret_leakage | mcpServers.web.headers.Authorization | - | high | mcp,plaintext_secret
vendor | 45 | 1 | nhi_database_url_with_credentials | CONNECTION_URL_CREDENTIALS | database | medium | plaintext_secret,modern_saas
vendor | 45 | 2 | nhi_bearer_token_detected | Authorization Bearer token | - | medium | plaintext_secret,http_auth
vendor | 45 | 3 | nhi_monitoring_dsn_exposed | SENTRY_DSN | sentry | medium | plaintext_secret,modern_saas
vendor | 45 | 4 | nhi_jwt_detected | JWT-like token | - | medium | plaintext_secret,jwt
iac | 46 | 2 | nhi_terraform_provisioner_exec | Terraform exec provisioner | cloud | medium | cloud,provisioner_exec
iac | 46 | 6 | nhi_service_account_key_file | Service account key resource | cloud | high | cloud,service_account_key
iac | 47 | 2 | nhi_docker_add_remote_url | ADD fetches remote URL | - | medium | docker,remote_content
ai | 48 | 1 | nhi_prompt_artifact_sensitive_disclosure | secret disclosure request | - | high | prompt_artifact,untrusted_context,sensitive_disclosure
ai | 48 | 2 | nhi_prompt_artifact_excessive_agency | excessive agency instruction | - | high | prompt_artifact,untrusted_context,excessive_agency
ai | 48 | 3 | nhi_prompt_artifact_hidden_instruction | hidden prompt instruction | - | high | prompt_artifact,untrusted_context,hidden_instruction
config | 49 | 2 | nhi_hardcoded_secret | token | - | medium | plaintext_secret,hardcoded_secret
registry | 49 | 2 | nhi_cargo_registry_token | cargo registry token | cargo | high | cargo,package_registry,publish_token,supply_chain
host | 50 | 1 | nhi_linux_pam_auth_chain_modified | PAM auth chain modified | - | high | linux_auth,pam,auth_chain
host | 50 | 1 | nhi_linux_pam_persistence_path | pam_exec.so | - | high | linux_auth,pam,persistence_path
ai | 51 | 1 | nhi_model_pickle_artifact | pickle model artifact | - | high | model_supply_chain,model_artifact
agents | 52 | 1 | nhi_ai_agent_filesystem_access | crew | - | high | ai_agent
""".strip().splitlines()
]
REPO_SQL = f"'repo_' || (o_custkey % {corpus.REPOS})"
N_KINDS = len(corpus.KINDS)


def planted_sql(detector: str) -> str:
    said = lambda x: "NULL" if x == "-" else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({kind}, {line}, " + ", ".join(map(said, rest)) + ")" for d, kind, line, *rest in PLANTED if d == detector)
    return (
        f"SELECT {REPO_SQL} AS repo, rule_id, line_no, name, provider, confidence, tags, count(*) AS n, count(DISTINCT o_orderkey) AS files "
        f"FROM orders JOIN (VALUES {rows}) v(kind, line_no, rule_id, name, provider, confidence, tags) ON o_orderkey % {N_KINDS} = kind GROUP BY ALL"
    )


def _detection(name: str, f) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return by_signal(f(corpus.artifacts(spark, sf_dir), S.key_table(spark, KEY)))

    register(f"detect_{name}", planted_sql(name))(run)


def _family(f: str):
    return lambda a, k: D.detect_family(a, f, k)


for _f in D.FAMILIES:
    _detection(_f, _family(_f))
for _n, _d in (
    ("env", D.detect_env_secrets), ("config", D.detect_credential_assignments), ("nested_secrets", D.detect_nested_secrets), ("windowed", D.detect_windowed),
    ("documents_settings", D.detect_documents), ("mcp", D.detect_mcp), ("agents", D.detect_ai_agents),
):
    _detection(_n, _d)


@register("detect_all", " UNION ALL ".join(planted_sql(d) for d in dict.fromkeys(row[0] for row in PLANTED)))
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector over the corpus at once: all that is planted, and nothing beside it."""
    return by_signal(D.detect_all(corpus.artifacts(spark, sf_dir), S.key_table(spark, KEY)))


HEX_ROWS = ", ".join(f"({i}, {c.count('{h}')})" for i, (_, c) in enumerate(corpus.KINDS) if "{h}" in c)


@register("detect_custom_regex", f"SELECT {REPO_SQL} AS repo, 'custom_hex' AS rule_id, sum(v.n)::BIGINT AS n, count(DISTINCT o_orderkey) AS files FROM orders JOIN (VALUES {HEX_ROWS}) v(kind, n) ON o_orderkey % {N_KINDS} = kind GROUP BY ALL")
def detect_custom_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = src.load_rule_pack('{"rules": [{"id": "custom_hex", "severity": "high", "pattern": "[0-9a-f]{40}"}, {"id": "bad", "pattern": "(a+)+$"}]}')
    return by_rule(D.detect_custom_regex(corpus.artifacts(spark, sf_dir), S.key_table(spark, KEY), pack))


@register(
    "detect_document_tokens",
    r"""SELECT source AS repo, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '(?i)[A-Za-z0-9_.-]*(api_key|apikey|secret|token|password|private_key|access_key)[A-Za-z0-9_.-]*\s*[:=]\s*[''"][0-9a-f]{40}[''"]') GROUP BY source""",
)
def detect_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.detect_credential_assignments(corpus.document_artifacts(spark, sf_dir), S.key_table(spark, KEY))
    return found.groupBy("repo").agg(F.count("*").alias("n"))


def _pad(x: int) -> str:
    return bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex()


@register(
    "fingerprints",
    f"SELECT o_orderkey, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(md5(o_orderkey::VARCHAR))))) AS fingerprint FROM orders",
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    return orders.select("o_orderkey", S.fingerprint(value, S.key_table(spark, KEY)).alias("fingerprint"))


@register(
    "secret_shapes",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 4 THEN true WHEN 5 THEN true ELSE false END AS secret,
    o_orderkey % 6 IN (1, 2, 3) AS placeholder, CASE o_orderkey % 6 WHEN 4 THEN 'github_token' WHEN 5 THEN 'openai_api_key' WHEN 3 THEN 'payment_key' ELSE 'secret' END AS label FROM orders""",
)
def secret_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    h = F.md5(k.cast("string").cast("binary"))
    v = F.element_at(F.array(F.concat(F.lit("v1"), h), F.lit("your-token-here"), F.lit("xxxxxxxxxxxxxxxx"), F.concat(F.lit("sk_test_"), h), F.concat(F.lit("ghp_a1"), h), F.concat(F.lit("sk-a1"), h)), (k % 6 + 1).cast("int"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", v.alias("v"))
    return orders.select("o_orderkey", S.looks_like_secret(F.col("v")).alias("secret"), S.is_placeholder(F.col("v")).alias("placeholder"), S.secret_label(F.col("v")).alias("label"))


@register("prepared_artifacts", f"SELECT {REPO_SQL} AS repo, count(*) AS files FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % {N_KINDS} NOT IN (4, 40, 48) GROUP BY ALL")
def prepared_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name gate, pruned folders, size gate and ignore rules in a row."""
    a = corpus.artifacts(spark, sf_dir)
    in_vendor = F.regexp_extract("path", r"[/w](\d+)", 1).cast("long") % 3 == 0
    a = a.withColumn("path", F.when(in_vendor, F.concat(F.lit("node_modules/"), "path")).otherwise(F.col("path")))
    rules = a.select("repo").distinct().select("repo", F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern")) for i, p in enumerate((".github/", "*.md", "!notes.md"))))))
    kept = src.apply_ignore_rules(src.size_gate(src.prune_dirs(src.scan_target_filter(a))), rules)
    return kept.groupBy("repo").agg(F.count("*").alias("files"))


FOLDER_SQL = "SELECT 'nation_' || c_nationkey AS repo, CASE c_custkey % 3 WHEN 0 THEN '.env' WHEN 1 THEN 'yml' ELSE 'txt' END AS kind, count(*) AS files, sum(length('KEY=') + 64)::BIGINT AS bytes FROM customer WHERE c_custkey % 5 <> 0 GROUP BY ALL"


@register("scanned_folder", FOLDER_SQL)
def scanned_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a file of a folder tree in the shared folder, hidden names and folders among them, read back
    through the data source; a fifth stand in folders that are never entered."""
    k = F.col("c_custkey")
    folder = F.when(k % 5 == 0, "node_modules/x/").otherwise("")
    name = F.when(k % 3 == 0, F.concat(F.lit("svc"), k, F.lit("/.env"))).when(k % 3 == 1, F.concat(F.lit(".github/workflows/w"), k, F.lit(".yml"))).otherwise(F.concat(F.lit("docs/_n"), k, F.lit(".txt")))
    text = F.concat(F.lit("KEY="), F.sha2(k.cast("string").cast("binary"), 256))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    root = f"{store.shared_dir(spark)}/idlens/tree-{uuid.uuid4().hex}"
    src.write_files(customers.select(F.concat(F.lit("nation_"), F.col("c_nationkey"), F.lit("/"), folder, name).alias("path"), text.cast("binary").alias("content")), root)
    found = src.read_artifacts(spark, root)
    return found.groupBy("repo", F.regexp_extract("path", r"(\.env|yml|txt)$", 1).alias("kind")).agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))


@register("changed_only", f"SELECT {REPO_SQL} AS repo, count(*) AS files FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL")
def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus.artifacts(spark, sf_dir)
    changed = a.where(F.regexp_extract("path", r"[/w](\d+)", 1).cast("long") % 5 == 0).select("repo", "path")
    return src.restrict_to_changed(a, changed).groupBy("repo").agg(F.count("*").alias("files"))


@register("incremental_misses", f"SELECT {REPO_SQL} AS repo, count(*) AS files FROM orders WHERE o_orderkey % {N_KINDS} NOT IN (4, 40) GROUP BY ALL")
def incremental_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of a second scan come from the cache; here the workflow files, whose signals hold no secret."""
    a = corpus.artifacts(spark, sf_dir)
    cached = a.where(F.col("path").startswith(".github")).select("content_sha", X.base_name().alias("name_key"), F.lit("v1").alias("version"), F.lit(None).cast("string").alias("secret_fingerprint"), F.lit("ci").alias("detector"))
    misses, _ = src.split_cached(a, cached, "v1")
    return misses.groupBy("repo").agg(F.count("*").alias("files"))


@register("flattened_json", "SELECT event_id, 'a.k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'b[1].c', event_type FROM events UNION ALL SELECT event_id, 'b[0]', '1' FROM events")
def flattened_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit('{"a":'), "props", F.lit(',"b":[1,{"c":"'), "event_type", F.lit('"}]}'))
    return events.select("event_id", F.inline(X.flatten_json(text)))


@register("config_pairs", f"SELECT o_orderkey, 'password' AS key, 2 AS line_no FROM orders WHERE o_orderkey % {N_KINDS} = 2 UNION ALL SELECT o_orderkey, 'host', 3 FROM orders WHERE o_orderkey % {N_KINDS} = 2")
def config_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus.artifacts(spark, sf_dir).where(F.col("path").endswith("settings.toml"))
    return a.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("o_orderkey"), F.inline(X.kv_pairs(F.col("content")))).drop("value")


@register(
    "codeowners_match",
    f"""SELECT {REPO_SQL} AS repo, CASE WHEN o_orderkey % {N_KINDS} IN (2, 3) THEN '@config' WHEN o_orderkey % {N_KINDS} IN (7, 46) THEN '@infra @ops' ELSE '@all' END AS owners, count(*) AS files FROM orders GROUP BY ALL""",
)
def codeowners_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus.artifacts(spark, sf_dir)
    text = "# owners\n* @all\n/conf/ @config\n*.tf @infra @ops\nnothing-here\n"
    files = a.select("scan_id", "repo").distinct().select("scan_id", "repo", F.lit("CODEOWNERS").alias("path"), F.lit(text).alias("content"))
    return I.match_codeowners(a, I.parse_codeowners(files)).groupBy("repo", "owners").agg(F.count("*").alias("files"))


@register("added_lines", "SELECT o_orderkey AS patch_id, 'a/x.py' AS path, unnest([5, 6, 20]) AS line_no FROM orders UNION ALL SELECT o_orderkey, 'b y.txt', 1 FROM orders WHERE o_orderkey % 2 = 0")
def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "0123456789abcdef\t0123456\tAnn\tann@example.org\t2024-05-01T00:00:00+00:00\tsubject\n"
    diff = "diff --git a/a/x.py b/a/x.py\n--- a/a/x.py\n+++ b/a/x.py\n@@ -4,0 +5,2 @@ def f\n+one\n+two\n@@ -18 +20 @@\n-old\n+new\n"
    more = 'diff --git a/b y.txt b/b y.txt\n--- /dev/null\n+++ "b/b y.txt"\n@@ -0,0 +1 @@\n+first\n'
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.lit(head + diff), F.when(F.col("o_orderkey") % 2 == 0, F.lit(more)).otherwise(F.lit("")))
    patches = orders.select(F.lit("r").alias("repo"), F.col("o_orderkey").alias("patch_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit("")).alias("_k"), text.alias("patch_text"))
    return src.added_lines(patches.select(F.col("_k").alias("repo"), "patch_id", "patch_text")).select(F.col("repo").cast("long").alias("patch_id"), "path", "line_no")


IDS = f"WITH b AS ({synthetic.BASE_SQL}), "
OWNERLESS = "owner IS NULL"
UNGATED = "coalesce(approval_required, false) = false"
UNLOGGED = "coalesce(logging_enabled, false) = false"
CORRELATIONS = f"""c AS (
  SELECT repo, 'nhi_secret_sprawl_same_file' AS rule_id FROM b WHERE has_secret GROUP BY repo, file_path HAVING count(*) >= 3
  UNION ALL SELECT repo, 'nhi_identity_exposure_chain' FROM b WHERE provider IS NOT NULL GROUP BY repo, provider HAVING count(*) >= 2 AND count(DISTINCT source) >= 2
  UNION ALL SELECT repo, 'nhi_history_secret_still_current' FROM b WHERE secret_fingerprint IS NOT NULL GROUP BY repo, secret_fingerprint HAVING bool_or(commit_sha IS NOT NULL) AND bool_or(commit_sha IS NULL)
  UNION ALL SELECT repo, 'nhi_customer_data_secret_coupling' FROM b WHERE has_secret AND data_access_level = 'customer' AND confidence <> 'low' GROUP BY repo, file_path, name
  UNION ALL SELECT repo, 'nhi_ai_mcp_privilege_bridge' FROM b GROUP BY repo HAVING bool_or(kind = 0 AND approval_required = false) AND bool_or(kind = 1)
  UNION ALL SELECT repo, 'nhi_ai_toxic_flow_untrusted_context_to_privileged_tool' FROM b GROUP BY repo HAVING bool_or(o_orderkey % 30 = 0) AND bool_or(kind IN (0, 1) AND {UNGATED})
  UNION ALL SELECT repo, 'nhi_ci_deployment_without_approval' FROM b GROUP BY repo HAVING bool_or(kind IN (3, 6) AND admin_access) AND bool_or(production_access AND kind IN (3, 6) AND {UNGATED} AND (admin_access OR deploys))
  UNION ALL SELECT repo, 'nhi_orphaned_identity_cluster' FROM b GROUP BY repo HAVING count(*) >= 8 AND count(*) FILTER ({OWNERLESS}) >= 0.75 * count(*) AND count(*) FILTER ({UNLOGGED}) >= 0.75 * count(*)
  UNION ALL SELECT repo, 'nhi_production_without_approval_gate' FROM b GROUP BY repo HAVING count(*) FILTER (production_access AND {UNGATED} AND (admin_access OR has_secret OR kind IN (0, 1) OR deploys)) >= 2
  UNION ALL SELECT repo, 'nhi_shared_target_exposure' FROM (SELECT repo, unnest([provider, CASE WHEN data_access_level <> 'unknown' THEN data_access_level END]) AS target, kind, admin_access OR production_access OR has_secret AS big FROM b)
    WHERE target IS NOT NULL GROUP BY repo HAVING max(0) = 0 AND repo IN (SELECT repo FROM (SELECT repo, provider AS t, kind, admin_access OR production_access OR has_secret AS big FROM b WHERE provider IS NOT NULL
      UNION ALL SELECT repo, data_access_level, kind, admin_access OR production_access OR has_secret FROM b WHERE data_access_level <> 'unknown') GROUP BY repo, t HAVING count(*) >= 3 AND count(DISTINCT kind) >= 2 AND bool_or(big)))"""


@register("correlations", IDS + CORRELATIONS + " SELECT repo, rule_id, count(*) AS n FROM c GROUP BY ALL")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.correlate(synthetic.identities(spark, sf_dir))
    return made.select("repo", F.col("ord.rule_id").alias("rule_id")).groupBy("repo", "rule_id").agg(F.count("*").alias("n"))


RISK_SQL = (
    IDS
    + f"""a AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_path, line_number, name, id) AS r FROM b WHERE kind IN (0, 1) AND ({UNGATED} OR admin_access)),
s AS (SELECT b.repo, b.id AS source, min_by(a.id, a.r) AS agent, any_value(b.file_path) AS f, any_value(b.line_number) AS l, any_value(b.name) AS n FROM b JOIN a ON a.repo = b.repo AND a.r <= 2 AND a.id <> b.id WHERE b.o_orderkey % 30 = 0 GROUP BY b.repo, b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY f, l, n, source) AS rk FROM s)
SELECT repo, source, agent FROM k WHERE rk <= 10"""
)


@register("risk_paths", RISK_SQL)
def risk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.risk_paths(synthetic.identities(spark, sf_dir))
    return made.select("repo", F.element_at("related_identities", 1).alias("source"), F.element_at("related_identities", 2).alias("agent"))


SCORE = f"""least(100, CASE WHEN has_secret THEN 30 ELSE 0 END + CASE WHEN admin_access THEN 25 ELSE 0 END + CASE WHEN production_access THEN 15 ELSE 0 END
 + CASE WHEN external_access THEN 10 ELSE 0 END + CASE WHEN data_access_level IN ('customer', 'session') THEN 15 ELSE 0 END + CASE WHEN approval_required = false THEN 15 ELSE 0 END
 + CASE WHEN {OWNERLESS} THEN 5 ELSE 0 END + CASE WHEN {UNLOGGED} THEN 5 ELSE 0 END)"""


@register("identity_scores", IDS + f"s AS (SELECT id, {SCORE} AS score FROM b) SELECT id, score, CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Medium' WHEN score >= 20 THEN 'Low' ELSE 'Clean' END AS label FROM s")
def identity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.identities(spark, sf_dir).select("id", R.score_identity().alias("score")).select("id", "score", R.severity_label(F.col("score")).alias("label"))


@register(
    "related_links",
    IDS + f"""r AS (SELECT *, row_number() OVER (ORDER BY file_path, line_number, name, id) AS o FROM b),
    u AS (SELECT repo, id FROM b WHERE production_access AND kind IN (3, 6) AND {UNGATED} AND (admin_access OR deploys) AND repo IN (SELECT repo FROM b WHERE kind IN (3, 6) AND admin_access)),
    t AS (SELECT repo, id, o, kind, provider AS target, admin_access OR production_access OR has_secret AS big FROM r WHERE provider IS NOT NULL
      UNION ALL SELECT repo, id, o, kind, data_access_level, admin_access OR production_access OR has_secret FROM r WHERE data_access_level <> 'unknown'),
    q AS (SELECT repo, target, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY min(o), target) AS nth FROM t GROUP BY repo, target HAVING count(*) >= 3 AND count(DISTINCT kind) >= 2 AND bool_or(big))
    SELECT repo, 'nhi_ci_deployment_without_approval' AS rule_id, count(*) OVER (PARTITION BY repo) AS n_related, id AS related_id FROM u
    UNION ALL SELECT repo, 'nhi_shared_target_exposure', n, id FROM t JOIN q USING (repo, target) WHERE nth = 1""",
)
def related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identities behind the correlations that relate any number of them."""
    i = synthetic.identities(spark, sf_dir).withColumn("ord", F.col("ord").cast(synthetic.PLACE))
    links = C.related_links(i.unionByName(C.correlate(i)))
    return links.where(F.col("rule_id").isin("nhi_ci_deployment_without_approval", "nhi_shared_target_exposure")).select("repo", "rule_id", "n_related", "related_id")


MATTERS = "(admin_access OR production_access OR external_access OR data_access_level <> 'unknown' OR deploys OR kind IN (0, 1, 2, 3, 4, 6))"
FINDINGS = f"""f AS (
  SELECT b.*, 'nhi_hardcoded_secret' AS rule_id, 75 AS base, true AS boosted FROM b WHERE has_secret
  UNION ALL SELECT b.*, 'nhi_overprivileged_nhi', 75, true FROM b WHERE admin_access
  UNION ALL SELECT b.*, 'nhi_ci_deployment_without_approval', 95, false FROM b WHERE kind IN (3, 6) AND production_access AND {UNGATED} AND (admin_access OR deploys)
  UNION ALL SELECT b.*, 'nhi_long_lived_unowned_credential', 75, false FROM b WHERE has_secret AND {OWNERLESS}
  UNION ALL SELECT b.*, 'nhi_no_rotation_policy', 45, false FROM b WHERE has_secret AND NOT {OWNERLESS}
  UNION ALL SELECT b.*, 'nhi_long_lived_secret', 55, false FROM b WHERE has_secret AND NOT {OWNERLESS}
  UNION ALL SELECT b.*, 'nhi_missing_owner', 30, false FROM b WHERE {MATTERS} AND {OWNERLESS} AND NOT has_secret
  UNION ALL SELECT b.*, 'nhi_missing_logging_evidence', 30, false FROM b WHERE {MATTERS} AND {UNLOGGED}
  UNION ALL SELECT b.*, 'nhi_nhi_reuse_suspected', 45, false FROM b WHERE secret_fingerprint IS NOT NULL AND (repo, secret_fingerprint) IN
    (SELECT (repo, secret_fingerprint) FROM (SELECT repo, secret_fingerprint, file_path, line_number FROM b WHERE secret_fingerprint IS NOT NULL GROUP BY ALL) GROUP BY repo, secret_fingerprint HAVING count(*) > 1)),
g AS (SELECT *, least(100, base + CASE WHEN boosted AND admin_access THEN 10 ELSE 0 END) AS raw FROM f),
h AS (SELECT *, CASE WHEN confidence = 'low' THEN greatest(20, raw - 25) ELSE raw END AS risk FROM g),
v AS (SELECT *, CASE WHEN risk >= 85 THEN 'critical' WHEN risk >= 65 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS severity FROM h)"""


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_rules(synthetic.identities(spark, sf_dir))


@register("findings", IDS + FINDINGS + " SELECT id AS identity_id, rule_id, risk AS risk_score, severity, CASE WHEN risk >= 80 THEN 'fix now' WHEN risk >= 60 THEN 'next sprint' ELSE 'planned hardening' END AS priority FROM v")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of(spark, sf_dir).select("identity_id", "rule_id", "risk_score", "severity", "priority")


OVERALL = f"""s AS (SELECT repo, max({SCORE}) AS m, count(*) AS n_identities FROM b GROUP BY repo), t AS (SELECT repo, max(risk) AS m, count(*) AS n_findings, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high FROM v GROUP BY repo)
SELECT repo, least(100, greatest(s.m, t.m) + least(30, n_findings * 3) + least(20, n_critical * 5))::BIGINT AS overall_score, n_identities, n_findings, n_critical,
CASE WHEN n_critical > 0 OR n_high > 0 THEN 'action_required' ELSE 'clean' END AS trust_level, CASE WHEN n_critical > 0 THEN 'block' WHEN n_high > 0 THEN 'manual_review' ELSE 'pass' END AS policy FROM s JOIN t USING (repo)"""


@register("scan_summary", IDS + FINDINGS + ", " + OVERALL)
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = synthetic.identities(spark, sf_dir)
    return R.scan_summary(i, R.run_rules(i)).select("repo", "overall_score", "n_identities", "n_findings", "n_critical", "trust_level", "policy")


@register("severity_counts", IDS + FINDINGS + " SELECT repo, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + " FROM v GROUP BY repo")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.severity_counts(findings_of(spark, sf_dir))


CATALOG_SQL = "(VALUES " + ", ".join(f"('{r}', '{c}', {o!r}, {a!r})".replace('"', "'") for r, _, _, c, o, a in rule_rows()) + ") k(rule_id, category, owasp, ai)"


@register("owasp_counts", IDS + FINDINGS + f" SELECT ref, count(*) AS n FROM (SELECT unnest(owasp) AS ref FROM v JOIN {CATALOG_SQL} USING (rule_id)) GROUP BY ref")
def owasp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.owasp_counts(findings_of(spark, sf_dir))


@register("top_themes", IDS + FINDINGS + f", p AS (SELECT repo, category, row_number() OVER (ORDER BY risk DESC, rule_id, file_path, category) AS seen FROM v JOIN {CATALOG_SQL} USING (rule_id)), q AS (SELECT repo, category, count(*) AS n, min(seen) AS seen FROM p GROUP BY repo, category), w AS (SELECT repo, category, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, seen) AS rank FROM q) SELECT * FROM w WHERE rank <= 5")
def top_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_themes(findings_of(spark, sf_dir))


@register("blast_radius", IDS.rstrip(", ") + " SELECT repo, bool_or(has_secret) AS secrets, bool_or(admin_access) AS admin, bool_or(production_access) AS production, bool_or(external_access) AS external, bool_or(data_access_level = 'customer') AS customer_data, bool_or(data_access_level = 'source-code') AS source_code, bool_or(kind IN (0, 1)) AS tools FROM b GROUP BY repo")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.blast_radius(synthetic.identities(spark, sf_dir)).drop("scan_id")


@register("identity_inventory", IDS.rstrip(", ") + " SELECT repo, " + "[" + ", ".join(f"'{t}'" for t in synthetic.TYPES) + "][kind + 1] AS identity_type, provider, count(*) AS n, count(*) FILTER (has_secret) AS n_secret FROM b GROUP BY ALL")
def identity_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.identity_inventory(synthetic.identities(spark, sf_dir))


MONTHS = "WITH f AS (SELECT DISTINCT 'repo_' || (l_suppkey % 20) AS repo, strftime(l_shipdate, '%Y-%m') AS scan_id, (l_partkey % 60)::VARCHAR AS key FROM lineitem), s AS (SELECT DISTINCT repo, scan_id FROM f), p AS (SELECT repo, scan_id, lag(scan_id) OVER (PARTITION BY repo ORDER BY scan_id) AS previous_scan_id FROM s)"


@register(
    "trend_history",
    MONTHS
    + """, q AS (SELECT * FROM p WHERE previous_scan_id IS NOT NULL), n AS (SELECT q.*, f.key FROM q JOIN f USING (repo, scan_id)), w AS (SELECT q.*, f.key FROM q JOIN f ON f.repo = q.repo AND f.scan_id = q.previous_scan_id)
SELECT repo, scan_id, previous_scan_id, count(*) FILTER (w.key IS NULL) AS n_new, count(*) FILTER (n.key IS NULL) AS n_resolved, count(*) FILTER (n.key IS NOT NULL AND w.key IS NOT NULL) AS n_unchanged
FROM n FULL JOIN w USING (repo, scan_id, previous_scan_id, key) GROUP BY ALL""".replace("n.key IS NULL", "n.k2 IS NULL").replace("w.key IS NULL", "w.k2 IS NULL").replace("n.key IS NOT NULL AND w.key IS NOT NULL", "n.k2 IS NOT NULL AND w.k2 IS NOT NULL").replace("SELECT q.*, f.key FROM", "SELECT q.*, f.key, f.key AS k2 FROM"),
)
def trend_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.trend_history(*synthetic.scan_keys(spark, sf_dir))


@register("previous_scan", MONTHS + " SELECT * FROM p")
def previous_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.previous_scan(synthetic.scan_keys(spark, sf_dir)[1]).drop("completed_at")


@register(
    "baseline_status",
    IDS + FINDINGS + """ SELECT repo, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'known' ELSE 'new' END AS baseline_status, count(*) AS n FROM (SELECT DISTINCT ON (id, rule_id) * FROM v) GROUP BY ALL""",
)
def baseline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth identity's findings are accepted; the odd half of them under a date that is over."""
    own = F.array(F.concat(F.lit("evidence of "), "identity_id"))
    f = findings_of(spark, sf_dir).withColumn("evidence", own)
    number = F.substring("identity_id", 2, 20).cast("long")
    base = B.write_baseline(f.where(number % 5 == 0)).withColumn("review_required", F.lit(False))
    keyed = f.where(number % 5 == 0).select(B.baseline_key().alias("key"), (number % 2 == 1).alias("over"))
    base = base.join(keyed.distinct(), "key").withColumn("accepted_until", F.when(F.col("over"), "2020-01-01").otherwise("2999-12-31"))
    return B.apply_baseline(f, B.active_baseline(base)).groupBy("repo", "baseline_status").agg(F.count("*").alias("n"))


@register("gate_status", IDS + FINDINGS + " SELECT repo, CASE WHEN bool_or(severity IN ('high', 'critical')) THEN 2 ELSE 1 END AS gate FROM v GROUP BY repo")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = synthetic.identities(spark, sf_dir)
    f = R.run_rules(i)
    return R.gate_status(f.withColumn("baseline_status", F.lit("new")), R.scan_summary(i, f)).drop("scan_id")


@register("detection_scorecard", f"SELECT 'planted' AS kind, count(*) AS cases, count(*) AS hit FROM orders WHERE o_orderkey % {N_KINDS} IN (2, 9) UNION ALL SELECT 'placebo', count(*), 0 FROM orders WHERE o_orderkey % {N_KINDS} IN (1, 11)")
def detection_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus.artifacts(spark, sf_dir)
    found = D.detect_credential_assignments(a, S.key_table(spark, KEY)).unionByName(D.detect_env_secrets(a, S.key_table(spark, KEY)))
    kind = F.when(F.col("path").rlike(r"settings\.toml|client\.py"), "planted").when(F.col("path").rlike(r"\.env\.example|notes\.md"), "placebo")
    labels = a.select(F.col("path").alias("case_id"), "repo", "path", F.lit("nhi_hardcoded_secret").alias("rule_id"), kind.alias("kind")).where("kind IS NOT NULL")
    return A.detection_scorecard(found.withColumnRenamed("path", "file_path"), labels)


@register("sarif_documents")
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sarif(findings_of(spark, sf_dir))


@register("scan_documents")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = synthetic.identities(spark, sf_dir)
    return A.scan_json(i, R.run_rules(i), C.risk_paths(i))


@register(
    "audit_hosts",
    """WITH h AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS w, s_suppkey % 3 = 0 AS odd FROM supplier)
SELECT 'nhi_linux_pam_module_world_writable' AS rule_id, count(*) AS n FROM h WHERE w UNION ALL SELECT 'nhi_linux_pam_unknown_module', 2 * count(*) FROM h WHERE odd
UNION ALL SELECT 'nhi_linux_pam_referenced_module_missing', count(*) FROM h WHERE NOT odd UNION ALL SELECT 'nhi_linux_pam_ssh_credential_theft_indicators', count(*) FROM h WHERE odd""",
)
def audit_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("concat('h', cast(s_suppkey AS string)) AS host", "s_suppkey % 2 = 0 AS w", "s_suppkey % 3 = 0 AS odd")
    module = F.when(F.col("odd"), "pam_steal.so").otherwise("pam_unix.so")
    lib = s.select("host", F.concat(F.lit("/lib/security/"), module).alias("path"), F.when(F.col("w"), 0o666).otherwise(0o644).alias("mode"), F.when(F.col("odd"), "\x01PAM_AUTHTOK\x02").otherwise("\x01plain text\x02").cast("binary").alias("content"))
    line = F.when(F.col("odd"), "auth required pam_steal.so\n").otherwise("auth required pam_deny.so\n")
    conf = s.select("host", F.lit("/etc/pam.d/sshd").alias("path"), F.lit(0o644).alias("mode"), line.cast("binary").alias("content"))
    return D.audit_hosts(src.host_inventory(lib.unionByName(conf)), S.key_table(spark, KEY)).groupBy("rule_id").agg(F.count("*").alias("n"))


AGENT_RULE = "nhi_ai_agent_shell_access"


@register("ai_ref_counts", IDS.rstrip(", ") + f" SELECT ref, count(*) AS n FROM (SELECT unnest(ai) AS ref FROM b JOIN {CATALOG_SQL} ON k.rule_id = '{AGENT_RULE}' WHERE kind = 0) GROUP BY ref")
def ai_ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of agents that carry one more tag."""
    i = synthetic.identities(spark, sf_dir)
    tags = F.when(F.col("identity_type") == "ai_agent", F.array_append("tags", F.lit(AGENT_RULE))).otherwise(F.col("tags"))
    return A.ai_ref_counts(R.run_rules(i.withColumn("tags", tags)))


@register(
    "identity_ai_refs",
    IDS + FINDINGS + f", w AS (SELECT id, rule_id, CASE WHEN o_orderkey % 5 = 0 THEN ['LLM01:2025', 'own:' || coalesce(provider, 'none')] ELSE []::VARCHAR[] END AS own FROM v)"
    + f" SELECT id AS identity_id, rule_id, array_to_string(list_sort(list_distinct(list_concat(own, ai))), ',') AS refs FROM w JOIN {CATALOG_SQL} USING (rule_id)",
)
def identity_ai_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings refer to what their rule and their identity refer to."""
    i = synthetic.identities(spark, sf_dir)
    own = F.array(F.lit("LLM01:2025"), F.concat(F.lit("own:"), F.coalesce("provider", F.lit("none"))))
    i = i.withColumn("ai_risk_refs", F.when(F.substring("id", 2, 20).cast("long") % 5 == 0, own).otherwise(F.col("ai_risk_refs")))
    return R.run_rules(i).select("identity_id", "rule_id", F.array_join("ai_risk_refs", ",").alias("refs"))


@register("sarif_results", IDS + FINDINGS + " SELECT repo, rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM v GROUP BY ALL")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the SARIF documents say, read back from their JSON."""
    kind = "runs array<struct<results: array<struct<ruleId: string, level: string>>>>"
    read = A.sarif(findings_of(spark, sf_dir)).select("repo", F.explode(F.from_json("sarif", kind)["runs"][0]["results"]).alias("r"))
    return read.groupBy("repo", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level")).agg(F.count("*").alias("n"))


@register(
    "enriched_owners",
    IDS.rstrip(", ") + """ SELECT id, CASE WHEN owner IS NULL AND commit_sha IS NULL THEN
    concat_ws('; ', CASE WHEN line_number % 2 = 0 THEN 'u' || line_number || '@example.org (last modified ' || strftime(make_timestamp((1705276800 + line_number % 10 * 2678400)::BIGINT * 1000000), '%Y-%m') || ')' END,
      CASE WHEN file_path LIKE 'f/1%.env' THEN '@ones' ELSE '@all' END || ' via CODEOWNERS') ELSE owner END AS owner FROM b""",
)
def enriched_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by last author of the line and by code owners; dates lie in the middle of months."""
    i = synthetic.identities(spark, sf_dir)
    blame = i.where("line_number % 2 = 0").selectExpr("repo", "file_path AS path", "line_number AS line", "concat('u', line_number, '@example.org') AS email", "1705276800L + line_number % 10 * 2678400L AS ts").distinct()
    owners = F.inline(F.array(*(F.struct(F.lit(n).alias("ord"), F.lit(g).alias("pattern"), F.lit(o).alias("owners")) for n, g, o in ((1, "*", "@all"), (2, "/f/1*.env", "@ones")))))
    return I.enrich_owners(i, blame, i.select("repo").distinct().select("repo", owners)).select("id", "owner")


@register("custom_structural", IDS.rstrip(", ") + " SELECT id, 'shell_secret' AS rule_id FROM b WHERE has_secret AND kind IN (0, 1) UNION ALL SELECT id, 'admin_by_name' FROM b WHERE admin_access AND name LIKE '%n1%'")
def custom_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = """{"rules": [{"id": "shell_secret", "type": "structural", "severity": "high", "when": {"has_secret": true, "tools_contains_any": ["SHELL"]}},
      {"id": "admin_by_name", "type": "structural", "severity": "low", "when": {"admin_access": true, "identity_name_contains": "N1"}}, {"id": "empty", "type": "structural", "severity": "low", "when": {}}]}"""
    return R.custom_structural(synthetic.identities(spark, sf_dir), src.load_rule_pack(pack)).select("id", "rule_id")


@register("deduped_signals", planted_sql("env"))
def deduped_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal twice; one stays."""
    found = D.detect_env_secrets(corpus.artifacts(spark, sf_dir), S.key_table(spark, KEY))
    return by_signal(I.dedupe_signals(found.unionByName(found)))


@register("deduped_identities", IDS.rstrip(", ") + " SELECT id, 'last' AS name, file_path AS first_path FROM b")
def deduped_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each identity again at a later place under another name: the last content at the first position."""
    i = synthetic.identities(spark, sf_dir)
    later = i.withColumn("name", F.lit("last")).withColumn("ord", F.col("ord").withField("path", F.concat(F.lit("z"), F.col("ord.path"))))
    return I.dedupe_identities(i.unionByName(later)).select("id", "name", F.col("ord.path").alias("first_path"))


@register(
    "normalized_fields",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'x|' || o_orderpriority ELSE 'a|' || o_orderpriority || '|b' END AS items, o_orderkey % 5 IN (0, 2) AS flag,
    CASE o_orderkey % 5 WHEN 0 THEN 'ai_agent' WHEN 1 THEN 'ci_runner' WHEN 2 THEN 'odd_thing' ELSE 'non_human_identity' END AS kind FROM orders""",
)
def normalized_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, booleans and identity types as signals write them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    items = F.when(k % 2 == 0, F.concat(F.lit('["x", " '), p, F.lit('", "x"]'))).otherwise(F.concat(F.lit("a, "), p, F.lit("; 'b',a")))
    pick = lambda *w: F.element_at(F.array(*map(F.lit, w)), (k % 5 + 1).cast("int"))
    return orders.select(
        "o_orderkey", F.array_join(I.normalize_string_list(items), "|").alias("items"), I.normalize_bool(pick("Yes", "off", "2", "maybe", None)).alias("flag"),
        I.canonical_identity_type(pick("AI-Agent", "ci/runner", "Odd  thing!", "", None)).alias("kind"),
    )


@register("redacted_text", "SELECT o_orderkey, false AS leaks, true AS keeps FROM orders")
def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No secret is left in a redacted text, and what stands around it stays."""
    k = F.col("o_orderkey")
    h = F.concat(F.lit("a1"), F.md5(k.cast("string").cast("binary")))
    shapes = F.array(F.concat(F.lit("user api_key="), h), F.concat(F.lit("user Authorization: Bearer "), h), F.concat(F.lit("user postgres://u:"), h, F.lit("@h/db")), F.concat(F.lit("user saw "), h, F.lit(" here")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", h.alias("h"), F.element_at(shapes, (k % 4 + 1).cast("int")).alias("t"))
    return S.redact_text(orders, "t", "r").select("o_orderkey", F.contains("r", "h").alias("leaks"), F.startswith("r", F.lit("user ")).alias("keeps"))


@register("tolerant_rows", "SELECT event_id % 3 = 0 AS skipped, count(*) AS n, count(CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END) AS n_k FROM events GROUP BY ALL")
def tolerant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row lacks the required key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("""CASE WHEN event_id % 3 = 0 THEN '{"other": 1}' ELSE props END""").alias("row"))
    read = store.read_store_tolerant(events, "row", T.StructType([T.StructField("k", T.StringType()), T.StructField("new", T.StringType())]), ["k"])
    return read.groupBy("skipped").agg(F.count("*").alias("n"), F.count("k").alias("n_k"))


@register(
    "block_lines",
    f"""SELECT o_orderkey, 2 AS line_no, '' AS key FROM orders WHERE o_orderkey % {N_KINDS} = 5 UNION ALL SELECT o_orderkey, 2, 'db.password' FROM orders WHERE o_orderkey % {N_KINDS} = 2
    UNION ALL SELECT o_orderkey, 3, 'db.host' FROM orders WHERE o_orderkey % {N_KINDS} = 2""",
)
def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside a `variables:` block, and pairs under their section."""
    a = corpus.artifacts(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("o_orderkey")
    inside = X.in_block(a.where(F.col("path").rlike(r"^ci/.*\.gitlab-ci\.yml$")), r"^variables:").where("inside")
    pairs = X.toml_section_pairs(a.where(F.col("path").endswith("settings.toml")))
    return inside.select(number, "line_no", F.lit("").alias("key")).unionByName(pairs.select(number, "line_no", "key"))


@register("printable_runs", "SELECT s_suppkey, s_name AS runs, 3 AS key_line, 2 AS offset_line FROM supplier")
def printable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable runs of a binary, and lines of a key and of an offset."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = F.concat(F.lit("a\nb\nkey = "), "s_name")
    runs = X.bounded_strings(F.concat(F.lit("\x01abc\x02"), "s_name", F.lit("\x00")).cast("binary"))
    return s.select("s_suppkey", F.array_join(runs, "|").alias("runs"), X.line_for_key_value(text, F.lit("x.key"), F.col("s_name")).alias("key_line"), X.line_at_offset(text, F.instr(text, "b")).alias("offset_line"))


@register(
    "masked_values",
    f"""SELECT o_orderkey, '[REDACTED:' || CASE WHEN o_orderkey % 2 = 0 THEN 'github_token' ELSE 'secret' END || ' len=' || length(v) || ' fp=' || left(sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(v)))), 8) || ']' AS masked,
    false AS weak, o_orderkey % 2 = 0 AS word FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ghp_a1' ELSE 'v1' END || md5(o_orderkey::VARCHAR) AS v FROM orders)""",
)
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks with the head of their fingerprints; no such value is a weak placeholder."""
    k = F.col("o_orderkey")
    v = F.concat(F.when(k % 2 == 0, "ghp_a1").otherwise("v1"), F.md5(k.cast("string").cast("binary")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", v.alias("v"))
    said = F.when(k % 2 == 0, "an exec call").otherwise("an executor")
    return orders.select("o_orderkey", S.mask(F.col("v"), S.fingerprint(F.col("v"), S.key_table(spark, KEY))).alias("masked"), (S.is_weak_placeholder(F.col("v")) | S.is_structural_placeholder(F.col("v")) | S.suppress_candidate(F.lit("name"), F.col("v"))).alias("weak"), X.has_word(said, ["exec", "shell"]).alias("word"))


@register(
    "scan_ids",
    """SELECT o_orderkey, 'scan_' || left(sha256(CASE WHEN o_orderkey % 3 = 0 THEN p || '|2024|' || n || '|' || f WHEN o_orderkey % 2 = 0 THEN p || '|' || c || '|v1' ELSE p || '|' || c || '|v1|dirty|diff' END), 16) AS scan_id
    FROM (SELECT o_orderkey, 'repo_' || (o_orderkey % 7) AS p, md5(o_orderkey::VARCHAR) AS c, (o_orderkey % 5)::VARCHAR AS n, (o_orderkey % 11)::VARCHAR AS f FROM orders)""",
)
def scan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans at a clean commit, at a changed one and at none."""
    k = F.col("o_orderkey")
    commit = F.when(k % 3 != 0, F.md5(k.cast("string").cast("binary")))
    made = R.scan_id(F.concat(F.lit("repo_"), (k % 7).cast("string")), commit, F.lit("v1"), F.when(k % 2 == 0, "").otherwise("diff"), F.lit("2024"), k % 5, k % 11)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", made.alias("scan_id"))


@register(
    "scan_stats",
    IDS + FINDINGS + f""", a AS (SELECT 's1' AS scan_id, repo, count(*) AS files_scanned, sum(o_orderkey % 100)::BIGINT AS bytes_scanned, count(*) AS identities, 0::BIGINT AS correlations FROM b GROUP BY repo),
    z AS (SELECT repo, count(*) FILTER (o_orderkey % 97 = 0) AS errors, count(DISTINCT file_path) FILTER (o_orderkey % 13 = 0) AS cache_hits FROM b GROUP BY repo), o AS (WITH {OVERALL}),
    c AS (SELECT repo, {", ".join(f"count(*) FILTER (severity = '{x}') AS findings_{x}" for x in ("critical", "high", "medium", "low"))} FROM v GROUP BY repo), d AS (SELECT repo, count(*) AS risk_paths FROM ({RISK_SQL}) GROUP BY repo)
    SELECT a.*, {", ".join(f"coalesce(findings_{x}, 0) AS findings_{x}" for x in ("critical", "high", "medium", "low"))}, coalesce(risk_paths, 0) AS risk_paths,
    errors, cache_hits, CASE WHEN overall_score >= 80 THEN 'Critical' WHEN overall_score >= 60 THEN 'High' WHEN overall_score >= 40 THEN 'Medium' WHEN overall_score >= 20 THEN 'Low' ELSE 'Clean' END AS severity_label, 'repo' AS surface
    FROM a LEFT JOIN c USING (repo) LEFT JOIN d USING (repo) LEFT JOIN z USING (repo) LEFT JOIN o USING (repo)""",
)
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = synthetic.identities(spark, sf_dir)
    files = i.select("scan_id", "repo", (F.substring("id", 2, 20).cast("long") % 100).alias("n_bytes"))
    number, place = F.substring("id", 2, 20).cast("long"), ["scan_id", "repo", F.col("file_path").alias("path")]
    errors = D.file_errors(i.where(number % 97 == 0).select("scan_id", "repo", F.concat("file_path", F.lit("/cdk.json")).alias("path"), F.lit("{not json").alias("content")))
    return R.scan_stats(files, i, R.run_rules(i), C.risk_paths(i), errors, i.where(number % 13 == 0).select(*place))


@register("stored_findings", IDS + FINDINGS + " SELECT repo, severity, count(*) AS n FROM v GROUP BY ALL")
def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings read back from the scan store."""
    root = f"{store.shared_dir(spark)}/idlens/store-{uuid.uuid4().hex}"
    store.write_scan(root, {"findings": findings_of(spark, sf_dir)})
    return store.findings_of(spark, root, "s1").groupBy("repo", "severity").agg(F.count("*").alias("n"))


@register("streamed_findings", IDS + FINDINGS + ", " + CORRELATIONS + """, w AS (SELECT repo, rule_id, count(*) AS n FROM v GROUP BY ALL)
  SELECT repo, rule_id, n, 'rule' AS kind FROM w UNION ALL SELECT repo, rule_id, count(*), 'correlation' FROM c GROUP BY ALL""")
def streamed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and correlations of a stream of two batches, none of which holds a repository whole."""
    root = f"{store.shared_dir(spark)}/idlens/stream-{uuid.uuid4().hex}"
    rows = synthetic.identities(spark, sf_dir).withColumn("ord", F.col("ord").cast(synthetic.PLACE))
    rows.withColumn("cut", F.pmod(F.xxhash64("id"), F.lit(2))).repartitionByRange(2, "cut").drop("cut").write.parquet(f"{root}/in")
    none = rows.where("false").select("scan_id", "repo", F.lit("").alias("path"))

    def take(df: DataFrame, number: int) -> None:
        state.advance(f"{root}/state", {"signals": df, "guards": none, "errors": none.withColumn("error", F.lit(""))}, number, base=lambda i: i)

    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    live.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found, correlated = state.current(spark, f"{root}/state", "findings"), F.col("source") == "advanced correlation"
    rules = found.where(~correlated).groupBy("repo", "rule_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("rule"))
    made = state.current(spark, f"{root}/state", "identities").where(correlated).groupBy("repo", F.col("ord.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))
    return rules.union(made.withColumn("kind", F.lit("correlation")))


@register("scan_document_rows", IDS + FINDINGS + " SELECT repo, rule_id, severity, count(*) AS n FROM v GROUP BY ALL")
def scan_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan documents say, read back from their JSON."""
    i = synthetic.identities(spark, sf_dir)
    made = A.scan_json(i, R.run_rules(i), C.risk_paths(i))
    read = made.select("repo", F.explode(F.from_json("json", "findings array<struct<rule_id: string, severity: string>>")["findings"]).alias("f"))
    return read.groupBy("repo", "f.rule_id", "f.severity").agg(F.count("*").alias("n"))


TITLES_SQL = "(VALUES " + ", ".join(f"('{row[0]}', '{row[1]}')" for row in rule_rows()) + ") k(rule_id, title)"


@register("degraded_scans", IDS + FINDINGS + f", o AS (WITH {OVERALL}), p AS (SELECT repo, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, arg_min(title, struct_pack(a := -risk, b := rule_id)) AS top FROM v JOIN {TITLES_SQL} USING (rule_id) GROUP BY repo)" + """,
    e AS (SELECT repo, count(*) AS n FROM b WHERE o_orderkey % 97 = 0 GROUP BY repo)
    SELECT repo, CASE WHEN repo = 'repo_3' THEN 'untrusted' WHEN e.repo IS NOT NULL THEN 'degraded' WHEN c > 0 OR h > 0 THEN 'action_required' ELSE 'clean' END AS trust_level,
    CASE WHEN repo = 'repo_3' OR c > 0 THEN 'block' WHEN e.repo IS NOT NULL OR h > 0 THEN 'manual_review' ELSE 'pass' END AS policy,
    CASE WHEN repo = 'repo_3' THEN 10 WHEN c > 0 OR h > 0 THEN 2 ELSE 1 END AS gate, CASE WHEN repo = 'repo_3' THEN 100 ELSE overall_score END AS overall_score,
    CASE WHEN repo = 'repo_3' THEN 'The scan did not end, so nothing it says can be relied on; it blocks until one ends.'
      WHEN e.repo IS NOT NULL THEN 'Incomplete: ' || e.n || ' files or steps failed. What is missing below is not proven clean.'
      ELSE c || ' critical and ' || h || ' high findings. Worst first: ' || top || '.' END AS summary FROM p JOIN o USING (repo) LEFT JOIN e USING (repo)""")
def degraded_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that could not be read lower the trust in a scan; one that did not end is not trusted at all."""
    i = synthetic.identities(spark, sf_dir)
    f = R.run_rules(i)
    number = F.substring("id", 2, 20).cast("long")
    errors = D.file_errors(i.where(number % 97 == 0).select("scan_id", "repo", F.concat("file_path", F.lit("/cdk.json")).alias("path"), F.lit("{not json").alias("content")))
    fatal = i.where("repo = 'repo_3'").select("scan_id", "repo").distinct()
    scans = R.scan_summary(i, f, errors, fatal)
    gates = R.gate_status(f.withColumn("baseline_status", F.lit("new")), scans)
    return scans.join(gates, ["scan_id", "repo"]).select("repo", "trust_level", "policy", "gate", "overall_score", "summary")


@register("full_scan")
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole scan of the derived corpus: the flagship."""
    return scan(corpus.artifacts(spark, sf_dir), KEY)["scans"]
