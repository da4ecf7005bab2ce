"""Runtime and dependency fingerprints: a small pattern dimension met with every file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.scoring import signal_confidence

MOST_EVIDENCE = 4


@dataclass(frozen=True)
class Fingerprint:
    id: str
    category: str
    patterns: tuple[str, ...]
    path: str | None = None
    identifier: str | None = None
    role: str = ""


#: Signs of runtimes, in order.
RUNTIMES = [
    Fingerprint("typescript-compiler", "compiler-runtime", ("typescript_exports", "ts_server_protocol_exports", "createProgram", "transpileModule", r"ts\.ScriptTarget", r"diagnosticMessages\.generated", "typescriptServices"), identifier="^requireTypescript$", role="embedded-compiler"),
    Fingerprint("babel-standalone", "compiler-runtime", ("babelHelpers", "transformFromAst", "transformSync", "parseSync", "@babel/standalone", "@babel/traverse", "VISITOR_KEYS", "regeneratorRuntime"), identifier="(?i)babel", role="embedded-compiler"),
    Fingerprint("prettier-standalone", "formatter-runtime", ("formatWithCursor", r"doc\.builders", "prettierPlugins", "__debug"), identifier="(?i)prettier", role="embedded-formatter"),
    Fingerprint("monaco-editor", "editor-runtime", (r"globalThis\.MonacoEnvironment", "StandaloneServices", r"monaco\.editor", r"monaco\.languages", "vs/editor", "EditorWorker", "tsWorker", r"workerMain\.js"), identifier="(?i)monaco", role="editor-runtime"),
    Fingerprint("react-reconciler", "framework-runtime", ("reconcilerVersion", "rendererPackageName", "injectIntoDevTools", "supportsMutation", "getPublicInstance", "createInstance", "appendChildToContainer"), role="react-renderer-runtime"),
    Fingerprint("vite-rollup-runtime", "bundler-runtime", ("__vitePreload", "__vite__mapDeps", r"\\0vite/preload-helper\.js", r"import\.meta\.url", "__commonJS", "__toESM", "__defProp"), role="bundler-runtime"),
    Fingerprint("webpack-runtime", "bundler-runtime", ("__webpack_require__", r"webpackChunk[\w$]*\.push", "webpackJsonp", "__webpack_exports__"), role="bundler-runtime"),
    Fingerprint("parcel-runtime", "bundler-runtime", ("parcelRequire", "newRequire", r"modules\[name\]\[0\]", "hmr-runtime"), role="bundler-runtime"),
    Fingerprint("systemjs-runtime", "bundler-runtime", (r"System\.register", r"System\.import"), role="bundler-runtime"),
    Fingerprint("wasm-bindgen-loader", "wasm-runtime", ("__wbindgen_malloc", "__wbindgen_free", "__wbindgen_start", "passStringToWasm0", "initSync", r"WebAssembly\.instantiateStreaming"), role="wasm-loader"),
    Fingerprint("emscripten-wasm-loader", "wasm-runtime", ("wasmBinaryFile", "locateFile", "createWasm", "instantiateAsync", "ENVIRONMENT_IS_WEB", "HEAPU8", "asmLibraryArg", "INITIAL_MEMORY", "noExitRuntime"), role="wasm-loader"),
    Fingerprint("inline-wasm-worker", "wasm-runtime", (r"WebAssembly\.validate", "new Uint8Array", "wasmpack", "workerProcess", r"new Worker\("), role="wasm-worker"),
    Fingerprint("worker-runtime", "worker-runtime", (r"self\.onmessage", r"postMessage\(", r"importScripts\(", r"new (?:Shared)?Worker\(", r"reference lib=[\"']webworker[\"']"), "(?i)worker", role="worker-entry"),
    Fingerprint("cad-kernel-bridge", "domain-runtime", ("opencascade", "OCCT", "TopoDS", "BRep", "STEPControl", "IGESControl", "StlAPI", "Manifold", r"setActiveBackend\([\"']occt[\"']\)", "shapeToGeometry", "getMesh", "kernel-native"), role="domain-bridge"),
    Fingerprint("three-runtime", "render-runtime", ("WebGLRenderer", "WebGPURenderer", r"THREE\.REVISION", "BufferGeometry", "Object3D", "Raycaster", "OrbitControls", "GLTFLoader", "DRACOLoader", "KTX2Loader"), role="render-runtime"),
]
#: Signs of packages.
DEPENDENCIES = [
    Fingerprint("react-router-dom", "dependency", ("react-router-dom|BrowserRouter|useNavigate|Routes|Navigate",)),
    Fingerprint("react", "dependency", (r"reactExports|jsxRuntimeExports|REACT_ELEMENT_TYPE|react\.transitional\.element|__REACT_DEVTOOLS_GLOBAL_HOOK__",)),
    Fingerprint("react-dom", "dependency", ("createRoot|hydrateRoot|react-dom|react-stack-top-frame",)),
    Fingerprint("three", "dependency", (r"from [\"']\./.*three|WebGLRenderer|WebGPURenderer|PerspectiveCamera|OrthographicCamera|Vector3|THREE\.REVISION|BufferGeometry",)),
    Fingerprint("@react-three/fiber", "dependency", (r"@react-three/fiber|__r3f|useFrame|<Canvas|Canvas\s*\(",)),
    Fingerprint("monaco-editor", "dependency", (r"monaco-editor|editor\.main|monaco\.languages|monaco\.editor|StandaloneServices|vs/editor",)),
    Fingerprint("highlight.js", "dependency", (r"highlight\.js|HighlightJS|hljs",)),
    Fingerprint("leva", "dependency", (r"\bleva\b|Leva",)),
    Fingerprint("@stripe/stripe-js", "dependency", (r"\bstripe\b|Stripe",)),
]


def signals(files: DataFrame, fingerprints: list[Fingerprint] = RUNTIMES) -> DataFrame:
    """(file_id, id, category, role, evidence, confidence): one row for each fingerprint a file shows.

    Evidence is the sign of the identifier, where files have such a column, then the path's,
    then patterns in order, at most four in all.
    """
    found = []
    named = "identifier" in files.columns
    for f in fingerprints:
        signs = [F.when(F.col("identifier").rlike(f.identifier), F.concat(F.lit("identifier:"), F.col("identifier")))] if f.identifier and named else []
        signs += [F.when(F.col("path").rlike(f.path), F.concat(F.lit("path:"), F.col("path")))] if f.path else []
        signs += [F.when(F.col("content").rlike(p), F.lit(p)) for p in f.patterns]
        evidence = F.slice(F.array_compact(F.array(*signs)), F.lit(1), F.lit(MOST_EVIDENCE))
        found.append(F.struct(F.lit(f.id).alias("id"), F.lit(f.category).alias("category"), F.lit(f.role).alias("role"), evidence.alias("evidence")))
    each = files.select("file_id", F.explode(F.array(*found)).alias("s")).select("file_id", "s.*").filter("size(evidence) > 0")
    return each.withColumn("confidence", signal_confidence(F.size("evidence")))


def primary_signal(rows: DataFrame) -> DataFrame:
    """The signal of most confidence of each file; ties go to the first id."""
    first = F.struct(-F.col("confidence"), F.col("id"))
    return rows.groupBy("file_id").agg(F.min_by(F.struct("id", "category", "confidence"), first).alias("s")).select("file_id", "s.*")


def module_type(files: DataFrame) -> DataFrame:
    """(module, commonjs, type): which syntax most files use; ties are ``module``."""
    counts = files.agg(F.count_if(F.col("content").rlike(r"(?m)^\s*(?:import|export)\b")).alias("module"), F.count_if(F.col("content").rlike(r"\bmodule\.exports\b|\brequire\(")).alias("commonjs"))
    return counts.withColumn("type", F.when(F.col("commonjs") > F.col("module"), "commonjs").otherwise("module"))
