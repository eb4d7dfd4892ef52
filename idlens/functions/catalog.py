"""Fixed catalogs as small tables: rules, their references, identity types, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule | base score | category | machine-identity references | AI references.
_RULES = """
nhi_secret_leakage | 70 | secret exposure | NHI2:2025 | -
nhi_plaintext_env_secret | 75 | secret exposure | NHI2:2025 | -
nhi_hardcoded_secret | 75 | secret exposure | NHI2:2025 | -
nhi_database_url_with_credentials | 80 | data access | NHI2:2025 NHI8:2025 | -
nhi_private_key_detected | 90 | key material | NHI2:2025 NHI4:2025 | -
nhi_cloud_key_detected | 85 | cloud access | NHI2:2025 NHI6:2025 | -
nhi_github_token_detected | 80 | source control access | NHI2:2025 NHI5:2025 | -
nhi_ai_provider_key_detected | 70 | AI service access | NHI2:2025 | LLM02:2025 LLM10:2025 NIST-AML:Misuse
nhi_payment_key_detected | 90 | payment access | NHI2:2025 | -
nhi_webhook_secret_exposed | 65 | webhook access | NHI2:2025 NHI3:2025 | -
nhi_oauth_client_secret_present | 75 | OAuth access | NHI2:2025 NHI4:2025 | -
nhi_broad_oauth_scope | 70 | OAuth scope | NHI5:2025 | -
nhi_overprivileged_nhi | 75 | privilege | NHI5:2025 | -
nhi_long_lived_secret | 55 | rotation | NHI7:2025 | -
nhi_no_rotation_policy | 45 | rotation | NHI7:2025 | -
nhi_environment_isolation_failure | 70 | environment isolation | NHI8:2025 | -
nhi_nhi_reuse_suspected | 45 | identity reuse | NHI9:2025 | -
nhi_human_use_of_nhi_suspected | 45 | governance | NHI10:2025 | -
nhi_ci_cd_broad_permissions | 70 | CI/CD | NHI5:2025 | -
nhi_github_actions_write_all | 90 | CI/CD | NHI5:2025 | -
nhi_github_actions_unpinned_action | 55 | third-party NHI | NHI3:2025 | -
nhi_github_actions_pull_request_target_secrets | 85 | CI/CD | NHI2:2025 NHI3:2025 | -
nhi_cloud_admin_policy | 90 | cloud access | NHI5:2025 NHI6:2025 | -
nhi_kubernetes_cluster_admin | 90 | kubernetes | NHI5:2025 NHI6:2025 | -
nhi_kubernetes_automount_token | 60 | kubernetes | NHI4:2025 NHI6:2025 | -
nhi_docker_privileged_container | 80 | container | NHI6:2025 | -
nhi_docker_socket_mount | 85 | container | NHI5:2025 NHI6:2025 | -
nhi_browser_extension_risky_permissions | 75 | browser/session access | NHI5:2025 | -
nhi_browser_extension_broad_host_background | 80 | browser/session access | NHI5:2025 NHI10:2025 | -
nhi_ai_agent_framework_detected | 45 | AI agent access | NHI1:2025 | LLM06:2025
nhi_ai_agent_unapproved_tool_access | 80 | AI agent access | NHI5:2025 NHI10:2025 | LLM06:2025 ASI02 ASI03
nhi_ai_agent_sensitive_data_access | 70 | AI agent access | NHI5:2025 | LLM02:2025 LLM06:2025 ASI03 NIST-AML:Privacy
nhi_ai_agent_shell_access | 90 | AI agent access | NHI5:2025 NHI10:2025 | LLM06:2025 ASI02 ASI03 ASI05
nhi_ai_agent_filesystem_access | 75 | AI agent access | NHI5:2025 NHI10:2025 | LLM02:2025 LLM06:2025 ASI02 ASI03
nhi_ai_agent_github_write_access | 90 | AI agent access | NHI5:2025 NHI10:2025 | LLM06:2025 ASI02 ASI03
nhi_mcp_server_high_risk_tool_access | 80 | MCP access | NHI5:2025 | -
nhi_mcp_filesystem_broad_access | 80 | MCP access | NHI5:2025 | -
nhi_tool_connector_high_risk_access | 70 | tool connector access | NHI5:2025 NHI10:2025 | LLM06:2025 ASI02
nhi_model_gateway_detected | 55 | model gateway access | NHI4:2025 NHI8:2025 | LLM02:2025 LLM03:2025
nhi_service_account_key_file | 85 | service account | NHI2:2025 NHI7:2025 | -
nhi_missing_owner | 30 | governance | NHI1:2025 | -
nhi_missing_logging_evidence | 30 | monitoring | NHI1:2025 NHI4:2025 | -
nhi_secret_sprawl_same_file | 85 | secret exposure | NHI2:2025 NHI9:2025 | -
nhi_identity_exposure_chain | 75 | blast radius | NHI5:2025 NHI8:2025 NHI9:2025 | -
nhi_ai_mcp_privilege_bridge | 95 | AI/MCP access | NHI5:2025 NHI10:2025 | LLM01:2025 LLM06:2025 ASI02 ASI03
nhi_untrusted_ci_deploy_path | 95 | CI/CD | NHI2:2025 NHI3:2025 NHI5:2025 | -
nhi_build_pipeline_secret_sink | 90 | build pipeline | NHI2:2025 NHI6:2025 | -
nhi_shadow_admin_path | 95 | privilege | NHI5:2025 NHI6:2025 | -
nhi_customer_data_secret_coupling | 90 | data access | NHI2:2025 NHI5:2025 | -
nhi_orphaned_identity_cluster | 70 | governance | NHI1:2025 | -
nhi_production_without_approval_gate | 90 | environment isolation | NHI8:2025 NHI10:2025 | -
nhi_ci_deployment_without_approval | 95 | CI/CD | NHI5:2025 NHI8:2025 NHI10:2025 | -
nhi_secret_file_not_gitignored | 65 | repository hygiene | NHI2:2025 | -
nhi_package_registry_token_detected | 80 | package registry access | NHI2:2025 NHI3:2025 | -
nhi_deployment_platform_token_detected | 85 | deployment access | NHI2:2025 NHI8:2025 | -
nhi_monitoring_dsn_exposed | 45 | monitoring | NHI3:2025 | -
nhi_encoded_registry_auth_detected | 80 | package registry access | NHI2:2025 NHI3:2025 | -
nhi_bearer_token_detected | 80 | API access | NHI2:2025 NHI4:2025 | -
nhi_jwt_detected | 70 | session or API token | NHI2:2025 NHI4:2025 | -
nhi_webhook_missing_signature_protection | 70 | webhook access | NHI3:2025 NHI4:2025 | -
nhi_production_ai_key_in_env | 90 | AI service access | NHI2:2025 NHI8:2025 | LLM02:2025 LLM10:2025 NIST-AML:Misuse
nhi_long_lived_unowned_credential | 75 | governance | NHI1:2025 NHI7:2025 | -
nhi_shared_target_exposure | 80 | blast radius | NHI5:2025 NHI9:2025 | -
nhi_prompt_artifact_prompt_injection | 80 | AI prompt security | NHI5:2025 NHI10:2025 | LLM01:2025 ASI01 NIST-AML:Misuse
nhi_prompt_artifact_system_prompt_leakage | 85 | AI prompt security | NHI2:2025 NHI10:2025 | LLM07:2025 LLM02:2025 ASI01 NIST-AML:Privacy
nhi_prompt_artifact_sensitive_disclosure | 90 | AI data exposure | NHI2:2025 | LLM02:2025 ASI01 NIST-AML:Privacy
nhi_prompt_artifact_excessive_agency | 85 | AI agent access | NHI5:2025 NHI10:2025 | LLM06:2025 ASI02 ASI03
nhi_prompt_artifact_hidden_instruction | 75 | AI prompt security | NHI5:2025 NHI10:2025 | LLM01:2025 ASI01 ASI06
nhi_prompt_contains_secret_or_credential | 75 | AI data exposure | NHI2:2025 | LLM02:2025 NIST-AML:Privacy
nhi_mcp_unpinned_remote_server | 80 | MCP supply chain | NHI3:2025 | LLM03:2025 ASI04
nhi_mcp_package_install_without_pinning | 80 | MCP supply chain | NHI3:2025 | LLM03:2025 ASI04
nhi_mcp_remote_script_execution | 95 | MCP supply chain | NHI3:2025 NHI5:2025 | LLM03:2025 ASI04 ASI05
nhi_mcp_writable_local_server_path | 80 | MCP supply chain | NHI3:2025 NHI5:2025 | LLM03:2025 ASI04 ASI05
nhi_mcp_env_secret_passthrough | 85 | MCP secret exposure | NHI2:2025 NHI5:2025 | LLM02:2025 ASI03 NIST-AML:Privacy
nhi_mcp_unsafe_runtime_flag | 85 | MCP runtime safety | NHI5:2025 | LLM06:2025 ASI02 ASI03
nhi_mcp_toxic_tool_combination | 95 | MCP toxic flow | NHI5:2025 NHI10:2025 | LLM01:2025 LLM06:2025 ASI02 ASI03
nhi_ai_tool_prompt_injection_description | 90 | AI tool poisoning | NHI5:2025 NHI10:2025 | LLM01:2025 ASI01 ASI02
nhi_ai_tool_shadowing | 75 | AI tool supply chain | NHI3:2025 | LLM03:2025 ASI04
nhi_ai_tool_name_description_mismatch | 80 | AI tool governance | NHI5:2025 NHI10:2025 | LLM06:2025 ASI02
nhi_ai_tool_untrusted_remote_source | 70 | AI tool supply chain | NHI3:2025 | LLM03:2025 ASI04
nhi_ai_tool_sensitive_sink | 85 | AI tool governance | NHI5:2025 NHI10:2025 | LLM06:2025 ASI02 ASI03
nhi_ai_toxic_flow_untrusted_context_to_privileged_tool | 95 | AI toxic flow | NHI5:2025 NHI10:2025 | LLM01:2025 LLM06:2025 ASI01 ASI02 ASI03
nhi_rag_untrusted_source_ingestion | 75 | RAG security | NHI3:2025 NHI5:2025 | LLM01:2025 LLM04:2025 LLM08:2025 ASI06 NIST-AML:Poisoning
nhi_rag_no_access_filter | 80 | RAG authorization | NHI2:2025 NHI5:2025 | LLM02:2025 LLM08:2025 NIST-AML:Privacy
nhi_rag_context_to_tool_bridge | 90 | RAG-to-tool bridge | NHI5:2025 NHI10:2025 | LLM01:2025 LLM06:2025 LLM08:2025 ASI02
nhi_vector_store_cross_tenant_risk | 85 | RAG authorization | NHI2:2025 NHI8:2025 | LLM02:2025 LLM08:2025 NIST-AML:Privacy
nhi_rag_poisoning_surface | 80 | RAG poisoning | NHI3:2025 | LLM04:2025 LLM08:2025 ASI06 NIST-AML:Poisoning
nhi_llm_output_exec_sink | 95 | improper output handling | NHI5:2025 NHI10:2025 | LLM05:2025 ASI05
nhi_llm_output_shell_sink | 95 | improper output handling | NHI5:2025 NHI10:2025 | LLM05:2025 LLM06:2025 ASI02 ASI05
nhi_llm_output_sql_sink | 85 | improper output handling | NHI5:2025 | LLM05:2025 NIST-AML:Misuse
nhi_llm_output_html_sink | 80 | improper output handling | NHI5:2025 | LLM05:2025
nhi_llm_function_call_without_schema | 75 | AI tool governance | NHI5:2025 NHI10:2025 | LLM05:2025 LLM06:2025 ASI02
nhi_llm_autonomous_action_without_gate | 90 | AI agent access | NHI5:2025 NHI10:2025 | LLM05:2025 LLM06:2025 ASI02 ASI03
nhi_model_trust_remote_code | 90 | model supply chain | NHI3:2025 NHI5:2025 | LLM03:2025 ASI04 ASI05
nhi_model_unpinned_revision | 70 | model supply chain | NHI3:2025 | LLM03:2025 ASI04
nhi_model_pickle_artifact | 75 | model supply chain | NHI3:2025 | LLM03:2025 ASI04 ASI05
nhi_model_gateway_unlogged_routing | 70 | model gateway access | NHI2:2025 NHI8:2025 | LLM02:2025 LLM03:2025
nhi_model_provider_fallback_without_policy | 75 | model gateway access | NHI3:2025 NHI8:2025 | LLM03:2025 LLM09:2025
nhi_model_container_unpinned_digest | 70 | model supply chain | NHI3:2025 NHI6:2025 | LLM03:2025 ASI04
nhi_ai_provider_unbounded_consumption | 70 | AI spend control | NHI5:2025 | LLM10:2025 NIST-AML:Misuse
nhi_linux_pam_unknown_module | 75 | Linux auth persistence | - | -
nhi_linux_pam_absolute_module_path | 75 | Linux auth persistence | - | -
nhi_linux_pam_module_outside_trusted_dir | 90 | Linux auth persistence | - | -
nhi_linux_pam_module_world_writable | 95 | Linux auth persistence | - | -
nhi_linux_pam_config_world_writable | 95 | Linux auth persistence | - | -
nhi_linux_pam_referenced_module_missing | 60 | Linux auth integrity | - | -
nhi_linux_pam_auth_chain_modified | 85 | Linux auth persistence | - | -
nhi_linux_pam_ssh_credential_theft_indicators | 95 | Linux auth credential theft | - | -
nhi_linux_pam_antiforensics_indicators | 90 | Linux auth anti-forensics | - | -
nhi_linux_pam_persistence_path | 85 | Linux auth persistence | - | -
nhi_npm_registry_token_in_npmrc | 80 | package registry access | NHI2:2025 NHI3:2025 | -
nhi_pypi_token_in_pypirc | 80 | package registry access | NHI2:2025 NHI3:2025 | -
nhi_cargo_registry_token | 80 | package registry access | NHI2:2025 NHI3:2025 | -
nhi_gradle_repository_credential | 80 | package registry access | NHI2:2025 NHI3:2025 | -
nhi_netrc_credential | 75 | machine credentials | NHI2:2025 NHI4:2025 | -
nhi_gitlab_ci_plaintext_variable | 75 | CI/CD | NHI2:2025 NHI8:2025 | -
nhi_gitlab_ci_job_token_exposure | 65 | CI/CD | NHI5:2025 NHI9:2025 | -
nhi_gitlab_ci_oidc_id_token | 55 | CI/CD | NHI6:2025 | -
nhi_gitlab_ci_vault_secrets | 45 | CI/CD | NHI5:2025 | -
nhi_gitlab_ci_unprotected_environment | 75 | CI/CD | NHI5:2025 NHI8:2025 | -
nhi_gitlab_ci_deployment_without_protected_check | 70 | CI/CD | NHI5:2025 NHI8:2025 | -
nhi_renovate_host_rules_plaintext_token | 80 | secret exposure | NHI2:2025 NHI3:2025 | -
nhi_renovate_automerge_enabled | 55 | bot governance | NHI3:2025 NHI5:2025 | -
nhi_renovate_vulnerability_alerts_disabled | 45 | bot governance | NHI3:2025 | -
nhi_renovate_extends_github_preset | 40 | third-party NHI | NHI3:2025 | -
nhi_renovate_bot_identity | 35 | bot inventory | NHI3:2025 NHI5:2025 | -
nhi_dependabot_bot_identity | 35 | bot inventory | NHI3:2025 NHI5:2025 | -
nhi_dependabot_targets_protected_branch | 55 | bot governance | NHI5:2025 NHI8:2025 | -
nhi_helm_values_plaintext_secret | 80 | secret exposure | NHI2:2025 NHI6:2025 | -
nhi_helm_values_image_pull_secret_inline | 75 | container registry access | NHI2:2025 NHI6:2025 | -
nhi_pulumi_config_plaintext_secret | 75 | IaC secret exposure | NHI2:2025 NHI6:2025 | -
nhi_aws_cdk_context_secret | 75 | IaC secret exposure | NHI2:2025 NHI6:2025 | -
nhi_bicep_param_missing_secure_decorator | 60 | IaC configuration | NHI6:2025 | -
nhi_bicep_param_default_plaintext_secret | 80 | IaC secret exposure | NHI2:2025 NHI6:2025 | -
nhi_terraform_state_plaintext_secret | 90 | IaC state exposure | NHI2:2025 NHI6:2025 NHI7:2025 | -
nhi_history_secret_still_current | 85 | git history exposure | NHI2:2025 NHI7:2025 | -
nhi_github_actions_expression_injection | 85 | CI/CD | NHI5:2025 NHI10:2025 | -
nhi_github_actions_prt_untrusted_checkout | 90 | CI/CD | NHI5:2025 NHI9:2025 | -
nhi_github_actions_self_hosted_runner | 55 | CI/CD | NHI5:2025 NHI6:2025 | -
nhi_github_actions_secrets_inherit | 55 | CI/CD | NHI2:2025 NHI5:2025 | -
nhi_gitlab_ci_debug_trace_enabled | 80 | CI/CD | NHI2:2025 NHI8:2025 | -
nhi_gitlab_ci_dind_privileged | 65 | CI/CD | NHI5:2025 NHI6:2025 | -
nhi_docker_remote_script_execution | 80 | container supply chain | NHI3:2025 NHI5:2025 | -
nhi_docker_add_remote_url | 55 | container supply chain | NHI3:2025 | -
nhi_kubernetes_env_plaintext_secret | 75 | kubernetes | NHI2:2025 NHI6:2025 | -
nhi_terraform_provisioner_exec | 60 | IaC execution | NHI5:2025 NHI6:2025 | -
nhi_npm_script_remote_execution | 70 | build pipeline | NHI3:2025 NHI5:2025 | -
nhi_ci_remote_script_execution | 70 | CI/CD | NHI3:2025 NHI5:2025 | -
nhi_ci_unpinned_component | 55 | third-party NHI | NHI3:2025 | -
nhi_jenkins_credentials_binding | 35 | CI/CD inventory | NHI2:2025 NHI5:2025 | -
nhi_circleci_context_usage | 35 | CI/CD inventory | NHI2:2025 NHI5:2025 | -
nhi_mcp_remote_server | 60 | MCP access | NHI3:2025 NHI5:2025 | -
"""

# Canonical identity types.
IDENTITY_TYPES = """ai_agent mcp_server model_gateway tool_connector oauth_app browser_extension ci_runner webhook_identity
service_account cloud_workload_identity api_key bot_account deployment_identity linux_auth_module""".split()

# Other spellings of the types.
TYPE_ALIASES = {
    "ai agent tool connector": "ai_agent",
    "ai_agent tool connector": "ai_agent",
    "ai agent": "ai_agent",
    "mcp server connector": "mcp_server",
    "mcp connector": "mcp_server",
    "oauth application": "oauth_app",
    "oauth app": "oauth_app",
    "browser extension identity": "browser_extension",
    "browser extension": "browser_extension",
    "ci/cd secret": "ci_runner",
    "ci_cd secret": "ci_runner",
    "ci_cd_secret": "ci_runner",
    "ci runner": "ci_runner",
    "github actions workflow token": "ci_runner",
    "webhook secret": "webhook_identity",
    "webhook url": "webhook_identity",
    "service account": "service_account",
    "cloud iam user": "cloud_workload_identity",
    "cloud iam role": "cloud_workload_identity",
    "cloud workload identity": "cloud_workload_identity",
    "api key": "api_key",
    "github token": "api_key",
    "package registry token": "api_key",
    "bot account": "bot_account",
    "deployment token": "deployment_identity",
    "deployment identity": "deployment_identity",
    "automation script credential": "deployment_identity",
    "linux pam module": "linux_auth_module",
    "linux auth module": "linux_auth_module",
}

# Rules that are of high confidence by themselves.
SURE_RULES = """nhi_private_key_detected nhi_service_account_key_file nhi_github_actions_write_all
nhi_github_actions_pull_request_target_secrets nhi_kubernetes_cluster_admin nhi_docker_socket_mount
nhi_mcp_filesystem_broad_access nhi_mcp_server_high_risk_tool_access nhi_ai_mcp_privilege_bridge
nhi_ai_agent_filesystem_access nhi_ai_agent_github_write_access nhi_browser_extension_broad_host_background
nhi_ci_deployment_without_approval nhi_production_ai_key_in_env nhi_webhook_missing_signature_protection
nhi_shared_target_exposure nhi_untrusted_ci_deploy_path nhi_shadow_admin_path nhi_cloud_key_detected
nhi_github_token_detected nhi_ai_provider_key_detected nhi_payment_key_detected
nhi_package_registry_token_detected nhi_deployment_platform_token_detected""".split()

# Labels of the references.
REF_LABELS = {
    "NHI1:2025": "Improper Offboarding",
    "NHI2:2025": "Secret Leakage",
    "NHI3:2025": "Vulnerable Third-Party NHI",
    "NHI4:2025": "Insecure Authentication",
    "NHI5:2025": "Overprivileged NHI",
    "NHI6:2025": "Insecure Cloud Deployment Configurations",
    "NHI7:2025": "Long-Lived Secrets",
    "NHI8:2025": "Environment Isolation",
    "NHI9:2025": "NHI Reuse",
    "NHI10:2025": "Human Use of NHI",
    "LLM01:2025": "Prompt Injection",
    "LLM02:2025": "Sensitive Information Disclosure",
    "LLM03:2025": "Supply Chain",
    "LLM04:2025": "Data and Model Poisoning",
    "LLM05:2025": "Improper Output Handling",
    "LLM06:2025": "Excessive Agency",
    "LLM07:2025": "System Prompt Leakage",
    "LLM08:2025": "Vector and Embedding Weaknesses",
    "LLM09:2025": "Misinformation",
    "LLM10:2025": "Unbounded Consumption",
    "ASI01": "Agent Goal Hijacking",
    "ASI02": "Tool Misuse",
    "ASI03": "Identity and Privilege Abuse",
    "ASI04": "Agentic Supply Chain Vulnerabilities",
    "ASI05": "Unexpected Code Execution",
    "ASI06": "Memory and Context Poisoning",
    "ASI07": "Insecure Inter-Agent Communication",
    "ASI08": "Cascading Failures",
    "ASI09": "Human-Agent Trust Exploitation",
    "ASI10": "Rogue Agents",
    "NIST-AML:Evasion": "Evasion",
    "NIST-AML:Poisoning": "Poisoning",
    "NIST-AML:Privacy": "Privacy",
    "NIST-AML:Misuse": "Misuse",
}


def rule_rows() -> list[tuple]:
    rows = [[x.strip() for x in line.split("|")] for line in _RULES.strip().splitlines()]
    words = lambda x: [] if x == "-" else x.split()
    return [(r, r.removeprefix("nhi_").replace("_", " ").capitalize(), int(base), category, words(owasp), words(ai)) for r, base, category, owasp, ai in rows]


def rule_catalog(spark: SparkSession) -> DataFrame:
    """(rule_id, title, base_score, category, owasp_nhi_refs, rule_ai_refs): 152 rows, so joins with it broadcast."""
    kind = "rule_id string, title string, base_score int, category string, owasp_nhi_refs array<string>, rule_ai_refs array<string>"
    return spark.createDataFrame(rule_rows(), kind)


def ref_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REF_LABELS.items()), "ref string, label string")
