"""Profiles and the fixed tables of asset naming."""

from __future__ import annotations

from dataclasses import dataclass, field

# Naming prefixes and the asset types they stand for.
NAME_PREFIXES = {
    "BP_": "Blueprint", "B_": "Blueprint", "ABP_": "Blueprint", "BPI_": "Blueprint", "GA_": "Blueprint",
    "GE_": "Blueprint", "GCN_": "Blueprint", "GCNL_": "Blueprint", "WBP_": "WidgetBlueprint",
    "W_": "WidgetBlueprint", "AC_": "Blueprint",
    "DT_": "DataTable", "CT_": "DataTable", "C_": "Curve", "DA_": "DataAsset", "INPUTDATA_": "DataAsset",
    "ENUM_": "Enum", "E_": "Enum", "F_": "Struct",
    "M_": "Material", "MI_": "MaterialInstance", "MT_": "MaterialInstance", "MF_": "MaterialFunction",
    "MPC_": "MaterialParameterCollection", "PPM_": "Material",
    "SM_": "StaticMesh", "SK_": "SkeletalMesh", "SKM_": "SkeletalMesh",
    "T_": "Texture", "TC_": "Texture", "RT_": "Texture", "HDR_": "Texture",
    "AM_": "Animation", "AS_": "Animation", "BS_": "Animation", "Rig_": "Animation", "SKEL_": "Animation",
    "CR_": "Animation",
    "NS_": "NiagaraSystem", "NE_": "NiagaraEmitter", "FXS_": "NiagaraSystem", "FXE_": "NiagaraEmitter",
    "PS_": "ParticleSystem",
    "MS_": "Sound", "SFX_": "Sound", "MX_": "Sound", "ATT_": "Sound", "SCON_": "Sound", "CB_": "Sound",
    "CBM_": "Sound", "PP_": "Sound", "CREV_": "Sound", "DYN_": "Sound", "FLT_": "Sound", "TAP_": "Sound",
    "IR_": "Sound", "LIB_": "Sound", "SC_": "Sound", "SW_": "Sound",
    "UI_": "WidgetBlueprint", "HUD_": "WidgetBlueprint",
    "LS_": "LevelSequence", "PHYS_": "PhysicsAsset", "PM_": "PhysicsMaterial",
    "IA_": "InputAction", "IMC_": "InputMappingContext",
}

# Export classes and the asset types they stand for.
CLASS_TYPES = {
    "Blueprint": "Blueprint", "BlueprintGeneratedClass": "Blueprint", "WidgetBlueprint": "WidgetBlueprint",
    "WidgetBlueprintGeneratedClass": "WidgetBlueprint", "AnimBlueprint": "Blueprint",
    "AnimBlueprintGeneratedClass": "Blueprint",
    "DataTable": "DataTable", "CurveTable": "DataTable", "CurveFloat": "Curve", "CurveLinearColor": "Curve",
    "CurveLinearColorAtlas": "Curve", "CurveVector": "Curve", "DataAsset": "DataAsset",
    "PrimaryDataAsset": "DataAsset", "PrimaryAssetLabel": "DataAsset", "UserDefinedStruct": "Struct",
    "UserDefinedEnum": "Enum", "Font": "Font", "FontFace": "Font",
    "Material": "Material", "MaterialInstanceConstant": "MaterialInstance",
    "MaterialInstanceDynamic": "MaterialInstance", "MaterialFunction": "MaterialFunction",
    "MaterialParameterCollection": "MaterialParameterCollection",
    "StaticMesh": "StaticMesh", "SkeletalMesh": "SkeletalMesh",
    "Texture2D": "Texture", "TextureCube": "Texture", "TextureRenderTarget2D": "Texture",
    "VolumeTexture": "Texture", "MediaTexture": "Texture",
    "AnimSequence": "Animation", "AnimMontage": "Animation", "BlendSpace": "Animation",
    "BlendSpace1D": "Animation", "AimOffsetBlendSpace": "Animation", "Skeleton": "Animation",
    "ControlRig": "Animation", "ControlRigBlueprint": "Animation",
    "NiagaraSystem": "NiagaraSystem", "NiagaraEmitter": "NiagaraEmitter", "ParticleSystem": "ParticleSystem",
    "SoundWave": "Sound", "SoundCue": "Sound", "SoundAttenuation": "Sound", "SoundConcurrency": "Sound",
    "SoundSubmix": "Sound", "ITDSpatializationSourceSettings": "Sound", "AudioImpulseResponse": "Sound",
    "SubmixEffectReverbPreset": "Sound", "SubmixEffectDynamicsProcessorPreset": "Sound",
    "SubmixEffectFilterPreset": "Sound", "SubmixEffectTapDelayPreset": "Sound", "SoundControlBus": "Sound",
    "SoundControlBusMix": "Sound", "SoundModulationParameter": "Sound", "SoundModulationParameterPatch": "Sound",
    "MetaSoundSource": "Sound", "SoundClass": "Sound", "SoundMix": "Sound",
    "Level": "Level", "World": "World", "LevelSequence": "LevelSequence",
    "PhysicsAsset": "PhysicsAsset", "PhysicalMaterial": "PhysicsMaterial",
    "InputAction": "InputAction", "InputMappingContext": "InputMappingContext",
}

# Starts of export classes that tell an asset type by structure.
STRUCTURE_MARKERS = {
    "K2Node_": "Blueprint", "EdGraph": "Blueprint", "MaterialExpression": "Material",
    "MaterialGraph": "Material", "DataTableExport": "DataTable",
}

# Rules of the quick guess, first hit wins: (type, starts of the name in lower case).
GUESSES = [
    ("Blueprint", ["bp_"]), ("WidgetBlueprint", ["wbp_", "wb_"]), ("DataTable", ["dt_"]), ("DataAsset", ["da_"]),
    ("MaterialInstance", ["mi_"]), ("MaterialFunction", ["mf_"]), ("Material", ["m_"]), ("Texture2D", ["t_"]),
    ("StaticMesh", ["sm_"]), ("SkeletalMesh", ["sk_", "skm_"]), ("AnimBlueprint", ["abp_"]),
    ("AnimMontage", ["am_"]), ("GameplayCue", ["gc_"]), ("GameplayAbility", ["ga_"]), ("GameplayEffect", ["ge_"]),
]

# Types of the trace's two sections.
STRUCTURAL_TYPES = ["WidgetBlueprint", "Blueprint", "DataAsset", "DataTable", "GameFeatureData", "InputAction", "InputMappingContext"]
VISUAL_TYPES = ["Material", "MaterialInstance", "MaterialFunction", "Texture", "Texture2D", "StaticMesh", "SkeletalMesh", "Sound", "SoundWave", "SoundCue", "NiagaraSystem", "ParticleSystem", "Animation", "AnimSequence", "AnimMontage"]
STRUCTURAL_PREFIXES = ["B_", "BP_", "W_", "WBP_", "DA_", "DT_", "GE_", "GA_", "GCN_"]

# Asset types that are indexed in full, and those whose references are kept.
SEMANTIC_TYPES = ["Blueprint", "WidgetBlueprint", "Material", "MaterialInstance", "MaterialFunction", "DataTable", "DataAsset", "GameFeatureData", "InputAction", "InputMappingContext"]
NO_REFERENCE_TYPES = ["Texture", "StaticMesh", "SkeletalMesh", "Animation", "Sound", "NiagaraSystem", "NiagaraEmitter", "ParticleSystem", "PhysicsAsset", "PhysicsMaterial"]


@dataclass(frozen=True)
class Profile:
    """A project's own names, on top of the fixed tables."""

    # The defaults of a project.
    class_types: dict[str, str] = field(default_factory=lambda: {"GameFeatureData": "GameFeatureData", "GameplayEffect": "GameplayEffect", "DataAsset": "DataAsset", "PrimaryDataAsset": "DataAsset", "PrimaryAssetLabel": "DataAsset", "GameSettingVisualData": "DataAsset"})
    name_prefixes: dict[str, str] = field(default_factory=lambda: {"GE_": "GameplayEffect", "L_": "World"})
    semantic_types: tuple[str, ...] = ("GameplayEffect",)
    deep_ref_classes: tuple[str, ...] = ("GameFeatureData", "DataRegistrySource_DataTable", "DataRegistry")
    deep_ref_names: tuple[str, ...] = ()
